"""Removal of passages that occur elsewhere, by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Every run of words
has a hash for each ``gram`` words; the least of a window's is its minimiser,
and consecutive windows that share it make a super-k-mer, which travels as one
packed string to the bucket of its minimiser. Equal windows have equal
minimisers, so each bucket can tell alone which of its windows repeat: it sorts
their hashes, and compares the words of windows that agree in it, so that no
collision counts.

How much travels is measured first: the bytes of the strings of each cell, a
class of minimisers. Cells are put together to buckets of at most ``bound``
bytes of strings. A cell beyond the bound (a phrase that some source repeats
everywhere) is split: each of its windows travels alone, to the bucket of its
own hash, so equal windows still meet.

Strings that repeat within a batch of documents are known to repeat there;
only one copy of each goes on, without its places, so a passage that a third
of all documents share arrives once from each batch. The strings of a batch
and a bucket travel together, compressed.

Words are the runs of bytes other than ASCII white space. Null texts have no
words; texts of any length are read whole. Input columns that are named as new
ones are replaced. Documents of fewer than ``window`` words have no window and stay whole.
Repeated rows count as occurrences of each other. Rows are told apart by id
and text, so ids may be null or repeat. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fresh, raw_texts, release, slices

WINDOW = 35
GRAM = 4
#: Bytes of text whose windows are looked at together; about 25 times as many are in use meanwhile.
SLICE = 1 << 20
#: Bytes of text in which a repeated string is measured once.
MEASURED = 6 << 20
#: Bytes of packed strings that a task gathers before it hands them on.
GATHER = 24 << 20
#: Bytes of packed strings that a bucket holds at most; about 25 times as many are in use while it is looked at.
BOUND = 16 << 20
#: Bytes of text to a cell. Its strings have about three times as many.
CELL = 64 << 10

_MIX1, _MIX2, _BYTE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        np.multiply.accumulate(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


_INVERSE = pow(int(_BYTE), -1, 1 << 64)


class Words:
    """Words of a buffer in which single spaces stand between them, with 64-bit hashes."""

    def __init__(self, text: bytes):
        self.text = text
        b = np.frombuffer(text, np.uint8)
        gap = np.flatnonzero(b == 32)
        self.start = np.concatenate([[0], gap + 1]) if len(b) else np.empty(0, np.int64)
        self.end = np.concatenate([gap, [len(b)]]) if len(b) else np.empty(0, np.int64)
        if not len(b):
            self.hash = np.empty(0, np.uint64)
            return
        # The hash of a word is its polynomial in bytes, from prefix sums over the buffer.
        size = int(1 << 16)
        up, down = _powers(size, int(_BYTE)), _powers(size, _INVERSE)
        total = np.zeros(len(b) + 1, np.uint64)
        step_up, scale = pow(int(_BYTE), size, 1 << 64), 1
        for at in range(0, len(b), size):
            part = (b[at : at + size].astype(np.uint64) + np.uint64(1)) * up[: len(b[at : at + size])] * np.uint64(scale)
            np.cumsum(part, out=total[at + 1 : at + 1 + len(part)])
            total[at + 1 : at + 1 + len(part)] += total[at]
            scale = scale * step_up % (1 << 64)
        block, rest = np.divmod(self.start, size)
        back = _powers(int(block[-1]) + 1, pow(_INVERSE, size, 1 << 64))
        raw = (total[self.end] - total[self.start]) * down[rest] * back[block]
        self.hash = mix(raw + (self.end - self.start).astype(np.uint64))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    out = h[: max(0, len(h) - n + 1)].copy()
    for i in range(1, n):
        out = mix(out * _BYTE + h[i : i + len(out)])
    return out


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, by prefix doubling."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    level, done = h, 1
    while done * 2 <= n:
        level = mix(level[: len(level) - done] * _BYTE + level[done:])
        done *= 2
    if done < n:
        level = mix(level[: len(level) - (n - done)] * _MIX2 + level[n - done :])
    return level


def super_kmers(words: Words, doc_of: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, windows in number, and minimiser of each super-k-mer."""
    n = len(words.hash) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    least = sliding_min(gram_hashes(words.hash, gram), window - gram + 1)
    whole = doc_of[:n] == doc_of[window - 1 :]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | (doc_of[1:n] != doc_of[: n - 1])
    first = np.flatnonzero(new)
    ends = np.append(first[1:], n)
    # windows that reach over the end of a document are the last ones of its run
    good = np.concatenate([[0], np.cumsum(whole)])
    count = good[ends] - good[first]
    held = count > 0
    # the whole windows of a run stand together, at its beginning
    return first[held], count[held], least[first[held]]


KEY, KEY_SIZE = "<qq?II", struct.calcsize("<qq?II")
"""Id (0 if null), fingerprint of the text, whether the id is null, first word and word after the last."""

_FOUND = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("blob", T.BinaryType())])
_SPANS = T.StructType([T.StructField("id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])


def _blob(strings: dict[bytes, list], known: list[tuple]) -> bytes:
    """Strings, the numbers of their windows, the places of those met once, and spans already known to repeat."""
    entries = strings.values()
    once = [struct.pack(KEY, *x[1]) for x in entries if x[1] is not None]
    return zstandard.ZstdCompressor(level=3).compress(
        struct.pack("<III", len(strings), len(once), len(known))
        + np.array([x[0] for x in entries], "<u4").tobytes()
        + np.array([x[1] is None for x in entries], "u1").tobytes()
        + b"".join(once)
        + b"".join(struct.pack(KEY, *x) for x in known)
        + b"\n".join(strings)
    )


class _Slice:
    """The words of a run of rows, and its super-k-mers."""

    def __init__(self, batch: pa.RecordBatch, window: int, gram: int):
        texts = [b" ".join(t.split()) for t in raw_texts(batch, "text")]
        self.some = [i for i, t in enumerate(texts) if t]
        self.words = Words(b" ".join(texts[i] for i in self.some))
        sizes = np.array([texts[i].count(b" ") + 1 for i in self.some], np.int64)
        self.doc_of = np.repeat(np.arange(len(self.some)), sizes)
        self.first_word = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.first, self.count, self.least = super_kmers(self.words, self.doc_of, window, gram)


def _cells(least: np.ndarray, cells: int) -> np.ndarray:
    return (mix(least.copy()) % np.uint64(cells)).astype(np.int64)


def _measured(rows: DataFrame, window: int, gram: int, cells: int) -> DataFrame:
    """(cell, whole, alone): bytes of the strings of a cell, as they are and with each window by itself.

    Strings that repeat within ``MEASURED`` bytes of text count once, much as they travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole_of, alone_of = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # names of strings, cells, sizes whole and alone
        seen = 0

        def add_up() -> None:
            nonlocal seen
            if found:
                name, cell, size, alone = (np.concatenate(x) for x in zip(*found, strict=True))
                one = np.unique(name, return_index=True)[1]
                np.add.at(whole_of, cell[one], size[one])
                np.add.at(alone_of, cell[one], alone[one])
                found.clear()
            seen = 0

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                x = _Slice(batch, window, gram)
                if not len(x.first):
                    continue
                if seen and seen + len(x.words.text) > MEASURED:
                    add_up()
                h = window_hashes(x.words.hash, window)
                name = mix(h[x.first] + x.count.astype(np.uint64)) + h[x.first + x.count - 1]
                name, one = np.unique(name, return_index=True)
                first, count, cell = x.first[one], x.count[one], _cells(x.least[one], cells)
                starts, ends = (np.concatenate([[0], np.cumsum(a)]) for a in (x.words.start, x.words.end))
                last = first + count + window - 1
                size = x.words.end[last - 1] - x.words.start[first] + 1
                alone = ends[last] - ends[first + window - 1] - starts[first + count] + starts[first] + count
                found.append((name, cell, size, alone))
                seen += len(x.words.text)
        add_up()
        release()
        held = np.flatnonzero(whole_of)
        for at in range(0, len(held), 1 << 16):
            part = held[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(whole_of[part]), pa.array(alone_of[part])], names=["cell", "whole", "alone"])

    return rows.mapInArrow(run, "cell long, whole long, alone long").groupBy("cell").agg(F.sum("whole").alias("whole"), F.sum("alone").alias("alone"))


def plan(rows: DataFrame, window: int, gram: int, buckets: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell its first bucket, and over how many buckets its windows are spread by their hashes."""
    text = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 << min(22, max(10, (text // CELL).bit_length()))
    found = _measured(rows, window, gram, cells).toArrow()
    whole, alone = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    at = found.column("cell").to_numpy()
    whole[at], alone[at] = found.column("whole").to_numpy(), found.column("alone").to_numpy()
    heavy = whole > bound
    light = np.where(heavy, 0, whole)
    # cells come one after the other, and a cell begins a bucket of its own where it would not fit
    most = max(1, min(bound, -(-int(light.sum()) // buckets)))
    base = np.zeros(cells, np.int64)
    bucket = held = 0
    for i in np.flatnonzero(light).tolist():
        if held and held + light[i] > most:
            bucket, held = bucket + 1, 0
        base[i] = bucket
        held += int(light[i])
    # parts are uneven, so they aim at half the bound
    spread = np.where(heavy, -(-2 * alone // bound), 1)
    base[heavy] = bucket + 1 + np.cumsum(spread[heavy]) - spread[heavy]
    return base.astype(np.int32), spread.astype(np.int32)


def _split(rows: DataFrame, window: int, gram: int, base: np.ndarray, spread: np.ndarray) -> DataFrame:
    """Rows (id, fp, text) to the blobs of the buckets that ``plan`` gave.

    Known spans take any bucket's blob: they only pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[int, dict[bytes, list]] = {}  # bucket -> string -> [windows, place or None]
        known: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(gathered)
            for at in range(0, len(names), 64):
                part = names[at : at + 64]
                blobs = [_blob(gathered[k], known[at + i :: len(names)]) for i, k in enumerate(part)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], names=_FOUND.names)
            gathered.clear()
            known.clear()

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                keys = [(i or 0, fp, i is None) for i, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                x = _Slice(batch, window, gram)
                if not len(x.first):
                    continue
                words, some = x.words, x.some
                cell = _cells(x.least, len(base))
                first, count, bucket, parts = x.first, x.count, base[cell].astype(np.int64), spread[cell].astype(np.int64)
                if (parts > 1).any():
                    times = np.where(parts > 1, count, 1)
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    alone = np.repeat(parts > 1, times)
                    first, bucket, parts = np.repeat(first, times) + nth, np.repeat(bucket, times), np.repeat(parts, times)
                    count = np.where(alone, 1, np.repeat(count, times))
                    bucket += (window_hashes(words.hash, window)[first] % parts.astype(np.uint64)).astype(np.int64)
                a, b = words.start[first].tolist(), words.end[first + count + window - 2].tolist()
                docs = x.doc_of[first]
                places = (first - x.first_word[docs]).tolist()
                bucket = bucket.tolist()
                text = words.text
                for s, e, n, d, p, k in zip(a, b, count.tolist(), docs.tolist(), places, bucket, strict=True):
                    string, place = text[s:e], (*keys[some[d]], p, p + n + window - 1)
                    into = gathered.setdefault(k, {})
                    seen = into.get(string)
                    if seen is None:
                        into[string] = [n, place]
                        held += e - s + 200
                        if held >= 2 * GATHER:
                            yield from flush()
                            held = 0
                        continue
                    if seen[1] is not None:
                        known.append(seen[1])
                        seen[1] = None
                    known.append(place)
                    if len(known) > 400_000:
                        yield from flush()
                        held = 0
                if held >= GATHER or len(known) > 200_000:
                    yield from flush()
                    held = 0
        yield from flush()
        release()

    return rows.mapInArrow(run, _FOUND)


def repeated_windows(strings: list[bytes], counts: np.ndarray, multi: np.ndarray, window: int) -> np.ndarray:
    """For each window of each string, in order, whether its words occur in another window too.

    ``multi`` marks strings that stand for more than one occurrence.
    """
    text = b" ".join(strings)
    words = Words(text)
    sizes = counts + window - 1
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    total = int(counts.sum())
    string_of = np.repeat(np.arange(len(strings)), counts)
    at = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + first[string_of]
    h = window_hashes(words.hash, window)[at]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    again = multi[string_of].copy()
    if same.any():
        begin, stop = words.start[at], words.end[at + window - 1]
        touched = np.zeros(total, bool)
        touched[1:] |= same
        touched[:-1] |= same
        edges = np.flatnonzero(touched)
        # groups of equal hashes: the words decide
        group = np.cumsum(np.concatenate([[True], ~same]))[edges]
        members = order[edges]
        heads = np.concatenate([[True], group[1:] != group[:-1]])
        b, e, g, hd = begin[members].tolist(), stop[members].tolist(), members.tolist(), heads.tolist()
        strings_seen: dict[bytes, int] = {}
        lead = b""
        for i, k in enumerate(g):
            piece = text[b[i] : e[i]]
            if hd[i]:
                lead, lead_at, strings_seen = piece, k, {}
            elif piece == lead:
                again[k] = again[lead_at] = True
            elif piece in strings_seen:
                again[k] = again[strings_seen[piece]] = True
            else:
                strings_seen[piece] = k
    return again


def _count(blobs: DataFrame, window: int) -> DataFrame:
    """(bucket, blob) rows to spans (id, fp, start, stop) of words to remove."""

    def run(whole: pa.Table) -> pa.Table:
        strings: list[bytes] = []
        counts, multi, owners = [], [], []
        places: list[tuple] = []
        known: list[tuple] = []
        for blob in whole.column("blob"):
            raw = zstandard.ZstdDecompressor().decompress(blob.as_py())
            n, once, more = struct.unpack_from("<III", raw)
            at = 12 + 5 * n
            counts.append(np.frombuffer(raw, "<u4", n, 12).astype(np.int64))
            multi.append(np.frombuffer(raw, "u1", n, 12 + 4 * n).astype(bool))
            owner = np.full(n, -1, np.int64)
            owner[~multi[-1]] = len(places) + np.arange(once)
            owners.append(owner)
            places += struct.iter_unpack(KEY, raw[at : at + KEY_SIZE * once])
            known += struct.iter_unpack(KEY, raw[at + KEY_SIZE * once : at + KEY_SIZE * (once + more)])
            strings += raw[at + KEY_SIZE * (once + more) :].split(b"\n")
        count, many, owner = (np.concatenate(x) for x in (counts, multi, owners))
        again = repeated_windows(strings, count, many, window)
        string_of = np.repeat(np.arange(len(strings)), count)
        index = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
        hit = np.flatnonzero(again & ~many[string_of])
        if len(hit):
            new = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(string_of[hit]) > 0)])
            first, last = hit[new], hit[np.append(new[1:], True)]
            for s, a, b in zip(string_of[first].tolist(), index[first].tolist(), index[last].tolist(), strict=True):
                i, fp, null, start, _ = places[owner[s]]
                known.append((i, fp, null, start + a, start + b + window))
        return pa.table(
            [
                pa.array([None if x[2] else x[0] for x in known], pa.int64()),
                pa.array([x[1] for x in known], pa.int64()),
                pa.array([x[3] for x in known], pa.int32()),
                pa.array([x[4] for x in known], pa.int32()),
            ],
            names=_SPANS.names,
        )

    return blobs.groupBy("bucket").applyInArrow(run, _SPANS)


def mark(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, buckets: int | None = None, bound: int = BOUND) -> DataFrame:
    """``docs`` with ``out`` added: array of (start, stop) word ranges to remove, by their starts.

    There are about ``buckets`` buckets; by default four times the shuffle
    partitions of the session, at least 64. There are more where one would
    hold more than ``bound`` bytes.
    """
    spark = docs.sparkSession
    buckets = buckets or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("fp"), F.col(text_col).alias("text"))
    spans = _count(_split(rows, window, gram, *plan(rows, window, gram, buckets, bound)), window)
    i, fp, own = fresh(docs, "id", "fp", "own")
    merged = spans.groupBy(F.col("id").alias(i), F.col("fp").alias(fp)).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias(out))
    left = docs.withColumn(own, F.xxhash64(F.col(text_col)))
    return left.join(merged, left[id_col].cast("long").eqNullSafe(merged[i]) & (left[own] == merged[fp]), "left").drop(i, fp, own)


def _apart(spans: list | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans or []:
        a, b = s["start"], s["stop"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words in the ranges and the white space between them."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return b"".join([*out, text[at:]])


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, buckets: int | None = None, bound: int = BOUND, rest: str | None = None) -> DataFrame:
    """``docs`` with ``kept`` (the words left, joined by a space), ``n_words`` and ``n_removed`` added.

    ``rest`` names a further column: the text with the removed words cut out
    and all white space around them as it was.
    """
    (spans_col,) = fresh(docs, "spans")
    marked = mark(docs, spans_col, id_col, text_col, window, gram, buckets, bound)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for batch in slices(whole, text_col, SLICE):
                spans = batch.column(batch.schema.get_field_index(spans_col)).to_pylist()
                kept, n_words, n_removed, whole_texts = [], [], [], []
                for text, own in zip(raw_texts(batch, text_col), spans, strict=True):
                    words = text.split()
                    n_words.append(len(words))
                    if own:
                        left, at = [], 0
                        for a, b in _apart(own):
                            left += words[at:a]
                            at = b
                        words = left + words[at:]
                    if rest:
                        whole_texts.append(cut_out(text, _apart(own)) if own else text)
                    kept.append(b" ".join(words))
                    n_removed.append(n_words[-1] - len(words))
                more = [pa.array(whole_texts, pa.binary()).cast(pa.string())] if rest else []
                yield batch, [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), *more]

    fields = [T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    fields += [T.StructField(rest, T.StringType())] if rest else []
    return append_columns(marked, fields, make).drop(spans_col)
