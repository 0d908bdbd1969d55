"""Byte-pair encoding and decoding, with a segment tree over adjacent pair ranks.

Each word is a row of symbols. A segment tree holds, at leaf ``i``, the rank
of the pair that starts at symbol ``i`` (with the position in the low bits, so
that equal ranks order from the left); its root therefore names the leftmost
lowest-rank merge. A merge changes three leaves, and each change climbs one
path to the root. Words of similar length stand in one matrix, so that a numpy
step makes one merge in every word of the matrix at once.

A word of more than ``LONG`` bytes has a tree of its own, so that a text
without spaces takes time in proportion to its length times the logarithm.

How words are found in text other than ASCII (classes of letters, lower case,
composition) depends on a version of Unicode; there the tokenizer library's own
normaliser and splitter decide, once for each distinct chunk between spaces.

A task keeps the ids of the words it has met (``MEMO`` of them at most), since
words repeat; memory stays bounded whatever the input.

Null and empty texts have no ids and decode to the empty text. Repeated rows
are encoded alike; an empty table gives an empty table; an input column that
has the name of an output column is replaced by it, all others stay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import append_columns, slices, texts

#: Words whose ids a task keeps before it forgets them all.
MEMO = 250_000
#: Bytes of text that are encoded together.
SLICE = 2 << 20
#: Symbols in one matrix at most.
MATRIX = 1 << 19
#: Bytes of a word from which on it has a tree of its own.
LONG = 2048
#: White space of Unicode, as the regular expressions of tokenizer files have it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = [], 256
    for b in range(256):
        letters.append(chr(b if b in plain else extra))
        extra += b not in plain
    return letters


class SegmentTreeBpe:
    """Vocabulary and merges of a tokenizer file, and the merging of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.width = len(self.names)
        pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            pairs[self.vocab[a] * self.width + self.vocab[b]] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.merged = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        self.table: dict[int, int] | None = None
        letters = byte_letters()
        self.inner = np.array([self.vocab[x] for x in letters], np.int64)
        self.last = np.array([self.vocab[x + self.suffix] for x in letters], np.int64)
        self.lower = "Lowercase" in [p.get("type") for p in spec["normalizer"]["normalizers"]] if spec["normalizer"] else False
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", SPACE))
        self.path, self.library = path, None
        self.bytes = {ord(x): b for b, x in enumerate(letters)}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def pair_ranks(self, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], none)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, given as bytes; none is empty."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._merge_long(w)
                continue
            by_width.setdefault(1 << (len(w) - 1).bit_length(), []).append(i)
        for width, members in by_width.items():
            step = max(1, MATRIX // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._merge([words[i] for i in part], max(2, width)), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], width: int) -> list[np.ndarray]:
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        column = np.arange(width)
        held = column[None, :] < size[:, None]
        symbols = np.full((n, width), -1, np.int64)
        symbols[held] = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        symbols[np.arange(n), size - 1] = self.last[[w[-1] for w in words]]
        after = np.where(column[None, :] + 1 < size[:, None], column[None, :] + 1, width)
        before = np.broadcast_to(column - 1, (n, width)).copy()
        none = np.int64(len(self.merged)) * width  # ranks stay below: no merge
        tree = np.full((n, 2 * width), none, np.int64)
        ranks = self.pair_ranks(symbols[:, :-1], symbols[:, 1:], len(self.merged))
        ranks[~held[:, 1:]] = len(self.merged)
        tree[:, width:-1] = np.where(ranks < len(self.merged), ranks * width + column[:-1], none)
        level = width
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
            level //= 2
        flat = tree.reshape(-1)
        symbol, nxt, prv = symbols.reshape(-1), after.reshape(-1), before.reshape(-1)
        row = np.flatnonzero(tree[:, 1] < none)
        while len(row):
            rank, at = np.divmod(flat[row * 2 * width + 1], width)
            base = row * width
            new = self.merged[rank]
            gone = nxt[base + at]
            then = nxt[base + gone]
            symbol[base + at] = new
            symbol[base + gone] = -1
            nxt[base + at] = then
            has = then < width
            prv[(base + then)[has]] = at[has]
            right = np.full(len(row), none, np.int64)
            found = self.pair_ranks(new[has], symbol[(base + then)[has]], len(self.merged))
            right[has] = np.where(found < len(self.merged), found * width + at[has], none)
            ahead = prv[base + at]
            led = ahead >= 0
            found = self.pair_ranks(symbol[(base + ahead)[led]], new[led], len(self.merged))
            top = row * 2 * width
            flat[top + width + gone] = none
            flat[top + width + at] = right
            flat[(top + width + ahead)[led]] = np.where(found < len(self.merged), found * width + ahead[led], none)
            node = np.concatenate([width + gone, width + at, (width + ahead)[led]]) >> 1
            tops = np.concatenate([top, top, top[led]])
            while node[0]:
                child = tops + 2 * node
                flat[tops + node] = np.minimum(flat[child], flat[child + 1])
                node >>= 1
            row = row[flat[row * 2 * width + 1] < none]
        kept = symbols >= 0
        return np.split(symbols[kept].astype(np.uint32), np.cumsum(kept.sum(1))[:-1])

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one word, by a tree over its pairs alone."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        find, wide, merged, none = self.table.get, self.width, self.merged.tolist(), len(self.merged)
        n = len(word)
        width = 1 << (n - 1).bit_length()
        first = self.inner[np.frombuffer(word, np.uint8)]
        first[-1] = self.last[word[-1]]
        leaf = np.full(width, none * width, np.int64)
        ranks = self.pair_ranks(first[:-1], first[1:], none)
        leaf[: n - 1] = np.where(ranks < none, ranks * width + np.arange(n - 1), none * width)
        levels = [leaf]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = np.concatenate([np.zeros(1, np.int64), *levels[::-1]]).tolist()
        symbol = first.tolist()
        after, before = [*range(1, n), n], [*range(-1, n - 1)]
        empty = none * width

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                a = a if a < b else b
                if tree[i] == a:
                    return
                tree[i] = a
                i >>= 1

        def rank(i: int, j: int) -> int:
            r = find(symbol[i] * wide + symbol[j])
            return empty if r is None else r * width + i

        while tree[1] < empty:
            r, i = divmod(tree[1], width)
            gone = after[i]
            then = after[gone]
            symbol[i], symbol[gone] = merged[r], -1
            after[i] = then
            put(gone, empty)
            if then < n:
                before[then] = i
            put(i, rank(i, then) if then < n else empty)
            if before[i] >= 0:
                put(before[i], rank(before[i], i))
        return np.array([x for x in symbol if x >= 0], np.uint32)

    def pieces(self, chunk: str) -> list[bytes | int]:
        """The words of a chunk of text as UTF-8, and the ids of special tokens between them."""
        out: list[bytes | int] = []
        for part in self.marks.split(chunk) if any(x in chunk for x in self.special) else [chunk]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if part.isascii():
                out += [w.encode() for w in self.words.findall(part.lower() if self.lower else part)]
            else:
                if self.library is None:
                    self.library = Tokenizer.from_file(self.path)
                split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part) if self.library.normalizer else part)
                out += [bytes(map(self.bytes.__getitem__, map(ord, w))) for w, _ in split]
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as little-endian 32-bit integers."""
        pieces = [self.pieces(c) for c in chunks]
        words = {w: None for ps in pieces for w in ps if isinstance(w, bytes)}
        ids = dict(zip(words, (x.astype("<u4").tobytes() for x in self.merge(list(words))), strict=True))
        return [b"".join(p.to_bytes(4, "little") if isinstance(p, int) else ids[p] for p in ps) for ps in pieces]

    def decode(self, ids: bytes) -> str:
        """Names of the tokens joined by a space, as a file without a decoder has it."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, SegmentTreeBpe] = {}
_MEMO: dict[str, dict[str, bytes]] = {}


def loaded(path: str) -> SegmentTreeBpe:
    if path not in _LOADED:
        _LOADED[path] = SegmentTreeBpe(path)
    return _LOADED[path]


def memory(path: str) -> dict[str, bytes]:
    return _MEMO.setdefault(path, {})


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` binary: the text's token ids, each as a little-endian unsigned 32-bit integer.

    ``tokenizer`` is the path of a tokenizer file of kind BPE, there on every
    executor. The text is cut at single spaces, which no word or special
    token of such a file crosses.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bpe, memo = loaded(tokenizer), memory(tokenizer)
        for whole in batches:
            for batch in slices(whole, text, SLICE):
                chunks = [t.split(" ") for t in texts(batch, text)]
                if len(memo) > MEMO:
                    memo.clear()
                new = list({c for cs in chunks for c in cs if c not in memo})
                memo.update(zip(new, bpe.encode_chunks(new), strict=True))
                yield batch, [pa.array([b"".join([memo[c] for c in cs]) for cs in chunks], pa.binary())]

    return append_columns(df, [T.StructField(ids, T.BinaryType())], make)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded`` string from the ids that encode() gives; null ids give the empty text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bpe = loaded(tokenizer)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            yield batch, [pa.array((bpe.decode(x.as_py() or b"") for x in column), pa.string())]

    return append_columns(df, [T.StructField(decoded, T.StringType())], make)
