"""Cost-balanced packing of documents into sequences of bounded length.

A piece of n tokens costs ``linear * n + quadratic * n**2``: attention stays
inside a document, so the square is of the piece. Documents go in descending
order of cost to the sequence that has the lowest cost so far among those with
room; a document that is longer than the room there is cut, and what is left
of it goes on to the next such sequence. Whole multiples of the capacity come
off a long document first, as sequences of their own.

Packing happens inside the tasks that tokenize, over windows of ``window``
tokens of consecutive documents: no token moves between executors, and memory
is bounded by a window and the longest document. A window's tokens fill whole
sequences of the capacity; what is over goes to sequences whose lengths are
the powers of two that add up to it, which need no padding.

Sequence ids are made of the task's partition and a count in it, so a task that
runs again gives the same ids. Documents of equal cost go in the order in
which the task reads them. Null texts are empty and have the end token
alone; repeated rows are packed one by one; an empty table gives an empty
table; only the id and text columns are read, so no other name can clash.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .bpe import SPACE, byte_letters
from .common import release, slices

#: Tokens that are packed together: about four thousand sequences of 1024.
WINDOW = 1 << 22
#: Chunks whose ids a task keeps before it forgets them all; it forgets them at its end too.
MEMO = 300_000
#: Bytes of text whose chunks are told apart together.
RUN = 4 << 20
#: Letters up to here are classed alike by every version of Unicode in use.
SETTLED = "ɐ"

_AFTER_SPACE = re.compile(f"[{SPACE}\\x1c-\\x1f] | [{SPACE}\\x1c-\\x1f]")
#: Space of settled letters, as Arrow's expressions have it.
BLANK = "\t-\r \x1c-\x1f\x85\xa0"
_CUT = re.compile(f"(?<=[^{SPACE}\\x1c-\\x1f]) (?=[^{SPACE}\\x1c-\\x1f])")


class ByteBpe:
    """Token ids of whole texts by a byte-level tokenizer file, with a memory for chunks.

    A chunk is what stands between single spaces, with the space before it:
    the file's pattern never looks across such a space. Chunks of settled
    letters go through the faster of two libraries over the same vocabulary.
    """

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        byte = {x: b for b, x in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, bytes] = {}
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[i for t, i in ranks.items() if t[0] == 32]] = True
        self.apart = "|".join([f"[^\0-{chr(ord(SETTLED) - 1)}]", r"\A |\A\z| \z", f"[{BLANK}] | [{BLANK}]", *map(re.escape, self.special)])

    def _chunk(self, chunk: str) -> bytes:
        if max(chunk, default="") < SETTLED and not any(s in chunk for s in self.special):
            ids = self.fast.encode_ordinary(chunk)
        else:
            ids = self.exact.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        chunks = _CUT.split(text) if _AFTER_SPACE.search(text) or text[0] == " " or text[-1] == " " else text.split(" ")
        memo = self.memo
        first = self._chunk(chunks[0])
        rest = chunks[1:]
        for c in {c for c in rest if c not in memo}:
            memo[c] = self._chunk(" " + c)
        ids = first + b"".join([memo[c] for c in rest])
        if len(memo) > MEMO:
            memo.clear()
        return ids


    def encode_all(self, column: pa.Array) -> list[bytes]:
        """``encode`` of every text of the column; null is empty.

        Texts of settled letters whose spaces are all single go together: each
        of their chunks is looked up once, and new ones are encoded in one
        call. Their ids part where a token opens with a space, which only the
        first of a chunk does, since no chunk has white space at its start.
        """
        column = pc.fill_null(column, "")
        apart = pc.match_substring_regex(column, self.apart)
        lists = pc.split_pattern(column.filter(pc.invert(apart)), " ")
        coded, sizes = lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy()
        chunks, codes, memo = coded.dictionary.to_pylist(), coded.indices.to_numpy().tolist(), self.memo
        new = [c for c in chunks if c not in memo]
        ended = {c for c in new if c[-1:].isspace() or c[:1].isspace()}  # at an edge of a text
        memo.update((c, self._chunk(" " + c)) for c in ended)
        new = [c for c in new if c not in ended] if ended else new
        if new:
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(new)), "<u4")
            cuts = (4 * np.flatnonzero(self.opens[ids])).tolist()
            data = ids.tobytes()
            memo.update(zip(new, map(data.__getitem__, map(slice, cuts, [*cuts[1:], len(data)])), strict=True))
        own = [memo[c] for c in chunks].__getitem__
        if len(memo) > MEMO:
            memo.clear()
        ends = np.cumsum(sizes).tolist()
        together = (self._chunk(chunks[codes[a]]) + b"".join(map(own, codes[a + 1 : b])) for a, b in zip([0, *ends], ends))
        return [self.encode(t.as_py()) if alone else next(together) for t, alone in zip(column, apart.to_pylist(), strict=True)]


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, descending."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover all tokens without padding.

    Sequences have ``capacity`` tokens, but for at most one of each lower
    power of two at the end.
    """
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    left: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            out.append((doc, start, capacity, sequence, 0))
            sequence, start = sequence + 1, start + capacity
        if n > start:
            left.append((start - n, doc, start))
    total = -sum(x[0] for x in left)
    rooms = [capacity] * (total // capacity) + powers(total % capacity)
    used = [0] * len(rooms)
    heap = [(0.0, i) for i in range(len(rooms))]
    for minus, doc, start in sorted(left):  # the longest has the highest cost
        n = -minus
        while n:
            cost, i = heapq.heappop(heap)
            take = min(n, rooms[i] - used[i])
            out.append((doc, start, take, sequence + i, used[i]))
            used[i] += take
            start, n = start + take, n - take
            if used[i] < rooms[i]:
                heapq.heappush(heap, (cost + linear * take + quadratic * take * take, i))
    return out


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    window: int = WINDOW,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a byte-level tokenizer file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        base = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        names: list[int | None] = []
        held = made = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, names, held, made
            pieces = pack([len(x) // 4 for x in ids], capacity, linear, quadratic)
            for at in range(0, len(pieces), 5000):
                part = pieces[at : at + 5000]
                doc, start, length, sequence, offset = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[d] for d in doc], pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array([ids[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in part], pa.binary()),
                        pa.array([len(ids[d]) // 4 for d in doc], pa.int64()),
                        pa.array([base + made + s for s in sequence], pa.int64()),
                        pa.array(offset, pa.int64()),
                    ],
                    names=PIECES.names,
                )
            made += max((p[3] for p in pieces), default=-1) + 1
            ids, names, held = [], [], 0

        for whole in batches:
            for batch in slices(whole, "t", RUN):
                for name, own in zip(batch.column(0).to_pylist(), bpe.encode_all(batch.column(1)), strict=True):
                    ids.append(own + end)
                    names.append(name)
                    held += len(ids[-1]) // 4
                    if held >= window:
                        yield from flush()
        if ids:
            yield from flush()
        bpe.memo.clear()
        release()

    narrow = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return narrow.mapInArrow(run, PIECES)


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in the place of ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
