"""Near-duplicates by SimHash, with candidates from pigeonring chains.

A fingerprint of 64 bits stands as a ring of four segments. If two differ in
at most ``MOST`` = 3 bits, some segment starts a chain in which the first l
segments together differ in at most l * 3/4 bits, for every l: none in the
first, one in two, two in three. Rotated to its start, each fingerprint gives
a key of 32 bits for that chain's first two segments, exactly and with each
bit of the second changed, so that rows of one key meet the budgets for l = 1
and 2; the budget for l = 3 and then all bits are tested in numpy on what is
left. Equal fingerprints are one node before that.

Of the links in a task only a spanning forest goes on: a large group of
copies gives as many rows as it has fingerprints, not pairs. Keys that many
fingerprints share are first joined over single bits, and only what is still
apart is compared.

Null texts have no words and fingerprint zero, which links like any other. A
bit that is set in exactly half of the hashes is 0. Texts of any length are
read whole, in the task that has them.
Null ids stay; they are never the smallest id, and a group without any id has
a null component. Repeated rows get the same result; an empty table gives an
empty one; only the id and text columns are read, so no other name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import append_columns, fresh, raw_texts
from .graph import components

MOST = 3
SHINGLE = 3
SEED = 42
#: Rows of one key from which on they are handled by themselves.
HOT = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, unsigned; 0 without words."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts, ends = [0, *[g + 1 for g in gaps]], [*gaps, len(joined)]
    digest = xxhash.xxh64_intdigest
    if len(starts) < shingle:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    total = np.zeros(64, np.int64)
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(octets), 1 << 16):
        total += np.unpackbits(octets[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprint(df: DataFrame, text_col: str = "text", out: str = "simhash") -> DataFrame:
    """Add the fingerprint as a signed long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in raw_texts(batch, text_col)], np.uint64)
            yield batch, [pa.array(found.view(np.int64))]

    return append_columns(df, [T.StructField(out, T.LongType())], make)


class Forest:
    """Union-find over the fingerprints that a task has linked."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        return True


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rotated fingerprints meet the budget of three segments, and that of all."""
    x = a ^ b
    return (np.bitwise_count(x >> np.uint64(16)) <= 2) & (np.bitwise_count(x) <= MOST)


def _hot_links(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect all of one key's fingerprints that links within the key connect."""
    values = np.unique(values)
    n = len(values)
    label = np.arange(n)

    def settle(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        nonlocal label
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = label[i], label[j]
            if x != y:
                label = np.where(label == max(x, y), min(x, y), label) if n < 2048 else _relabel(label, x, y)
                yield int(values[i]), int(values[j])

    for bit in range(64):  # distance 1: equal but for the bit
        masked = values & ~np.uint64(1 << bit)
        order = np.argsort(masked, kind="stable")
        same = masked[order[1:]] == masked[order[:-1]]
        yield from settle(order[:-1][same], order[1:][same])
    names, sizes = np.unique(label, return_counts=True)
    for small in np.flatnonzero(label != names[sizes.argmax()]).tolist():
        close = np.flatnonzero((np.bitwise_count(values ^ values[small]) <= MOST) & (label != label[small]))
        yield from settle(np.full(len(close), small), close)


def _relabel(label: np.ndarray, x: int, y: int) -> np.ndarray:
    label[label == max(x, y)] = min(x, y)
    return label


def links(prints: DataFrame) -> DataFrame:
    """(u, v) pairs that connect the distinct fingerprints ``fp`` wherever 3 bits or fewer lie between."""
    turned = F.expr("shiftleft(fp, 16 * cast(j div 17 as int)) | if(j div 17 = 0, 0L, shiftrightunsigned(fp, 64 - 16 * cast(j div 17 as int)))")
    key = F.expr("shiftleft(cast(j div 17 as bigint), 32) | (shiftrightunsigned(turned, 32) ^ if(j % 17 = 0, 0L, shiftleft(1L, cast(j % 17 - 1 as int))))")
    rows = (
        prints.select("fp", F.explode(F.expr("sequence(0, 67)")).alias("j"))
        .withColumn("turned", turned)
        .select(key.alias("key"), F.expr("j % 17 = 0").alias("exact"), "turned")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def solve(key: np.ndarray, exact: np.ndarray, turned: np.ndarray) -> pa.RecordBatch:
            first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            size = np.diff(np.append(first, len(key)))
            group = np.repeat(np.arange(len(first)), size)
            useful = np.logical_or.reduceat(exact, first) & (size > 1)
            found: list[tuple[int, int]] = []

            def keep(pairs: Iterator[tuple[int, int]], turn: np.ndarray) -> None:
                for (a, b), t in zip(pairs, turn, strict=True):
                    a = (a >> t | a << (64 - t)) & 0xFFFFFFFFFFFFFFFF
                    b = (b >> t | b << (64 - t)) & 0xFFFFFFFFFFFFFFFF
                    if forest.join(a, b):
                        found.append((a, b))

            small = np.flatnonzero((useful & (size < HOT))[group])
            for gap in range(1, HOT):
                small = small[small + gap < len(key)]
                small = small[group[small] == group[small + gap]]
                if not len(small):
                    break
                ok = (exact[small] | exact[small + gap]) & _near(turned[small], turned[small + gap])
                a, b = small[ok], small[ok] + gap
                keep(zip(turned[a].tolist(), turned[b].tolist(), strict=True), (key[a] >> 32 << 4).tolist())
            for g in np.flatnonzero(useful & (size >= HOT)).tolist():
                pairs = list(_hot_links(turned[first[g] : first[g] + size[g]]))
                keep(iter(pairs), [int(key[first[g]]) >> 32 << 4] * len(pairs))
            u, v = (np.array(x, np.uint64).view(np.int64) for x in (zip(*found, strict=True) if found else ([], [])))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = (batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(np.uint64))
            if part[0][0] == part[0][-1] and (not held or held[-1][0][-1] == part[0][0]):
                held.append(part)  # one key goes on over batches
                continue
            key, exact, turned = (np.concatenate(x) for x in zip(*held, part, strict=True)) if held else part
            last = np.searchsorted(key, key[-1])
            held = [(key[last:], exact[last:], turned[last:])]
            if last:
                yield solve(key[:last], exact[:last], turned[:last])
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    placed = rows.repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, simhash (signed), component_id, group, row.

    ``component_id`` is the smallest id of all documents that links reach,
    ``group`` names the component by one of its fingerprints, ``row`` is a hash
    of id and text by which rows are found again.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = cut(with_fingerprint(narrow).select("doc_id", "simhash", _row("doc_id", "text").alias("row")))
    prints = marked.groupBy(F.col("simhash").alias("fp")).agg(F.min("doc_id").alias("least"))
    roots = components(links(prints.select("fp")))
    named = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("group"))
    ids = named.groupBy("group").agg(F.min("least").alias("component_id"))
    full = named.join(ids, "group").select("fp", "group", "component_id")
    return marked.join(full, marked.simhash == full.fp).select("doc_id", "simhash", "component_id", "group", "row")


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group one row, that of the smallest id (of several texts with it, the one with the least hash).

    Texts are fingerprinted once; the rows that stay are found again by their id
    and a hash of id and text, and repeated rows meet in the same task as that join's.
    """
    row, own = fresh(docs, "row", "own")
    near = near_duplicates(docs, id_col, text_col).where("doc_id <=> component_id")
    best = near.groupBy("group", F.col("doc_id").alias(own)).agg(F.min("row").alias(row)).select(row, own)
    marked = docs.withColumn(row, _row(id_col, text_col))
    met = (marked[row] == best[row]) & F.col(f"`{id_col}`").cast("long").eqNullSafe(best[own])
    return marked.join(best, met, "left_semi").dropDuplicates([row, id_col]).drop(row)
