"""Mixing sources to target weights, with copies of documents rounded by pivots.

Sources share the mix by weight; none gets more than ``limit`` times its size, and
what it can't take is shared by the others. So every document of a source is to
be copied ``target / source_size`` times, which is seldom a whole number. The
whole part is certain; the fraction is rounded so that a source's words stay at its target:
two documents meet, and words move at random from one to the other until one of
the two is whole, so that expectations hold and the sum stays. What is
left of a group, one document at most, goes on to the next level of a reduction tree:
groups of about ``LEAF`` documents by a hash, then ``FAN`` groups to one, until each
source has one fractional document, which a last draw rounds.

A document that holds over 1 / ``SHARE`` of its source comes first (there are ``SHARE``
of them at most): these are rounded by classes of like size, the largest first, and what
rounding leaves over is made up for by smaller ones. The rest then aims at what the
long ones left. So a source misses its target by less than one of its smaller documents.

A source may hold any part of the rows: its tree has leaves enough. Equal rows (id,
source and text) are one unit with a count, rounded at once, so that they
can't fill a leaf. All draws are hashes of id, text and level: the result
depends on the rows alone, not on their order or partitions, and lost tasks give the same again.

Sizes are counted over whole texts of any length; null texts and those without words have
size 0 and take nothing. Null is a source of its own, the last. Rows without an id are
kept, and told apart by their texts. An empty table gives an empty table. Only the id, text and
source columns are read, so no other name can clash. The sources are joined by broadcast
while there are ``FEW`` at most, else by a sorted join that is split where it is skewed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import remove_folder
from .common import slices, stored_at

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3
LEAF, FAN, SHARE, FEW = 4096, 64, 1000, 100_000
SEED = 12
SLICE = 8 << 20
#: Below this a fraction is nothing.
TINY = 1e-12
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_counts(column: pa.Array) -> np.ndarray:
    """Words (runs of anything but ASCII white space) of each text; null has none."""
    raw = pc.fill_null(column, "").cast(pa.binary())
    at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    out = np.zeros(len(raw), np.int64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        space = _SPACE[np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]]]
        first = ~space
        first[1:] &= space[:-1]
        heads = (at[some] - at[0]).astype(np.int64)
        first[heads] = ~space[heads]
        out[some] = np.add.reduceat(first.view(np.uint8), heads, dtype=np.int64)
    return out


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(id, source, size, h, n): different rows, their words, a hash of id and text, and how often they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "t", SLICE):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(word_counts(b.column(3))), b.column(2)], names=["id", "source", "size", "h"])

    i, t = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    narrow = docs.select(i.alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.lit(seed), i, t).alias("h"), t.alias("t"))
    return narrow.mapInArrow(run, "id long, source string, size long, h long").groupBy("id", "source", "size", "h").agg(F.count("*").alias("n"))


def targets(rows: DataFrame, weights: Sequence[float] = WEIGHTS, limit: int = LIMIT, share: float = 1.0) -> tuple[DataFrame, str, int]:
    """(source, number, source_size, rows, target), its folder and how many sources there are.

    Sources are numbered by code point, null last, and weigh ``weights`` in turn. The
    common level rises until all words are given out; a source stops at its limit.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    listed, first = stored_at(sizes.sort(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = sorted(listed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row for each task that sorted
    before, n_sources = [], 0
    for part_id, n in counts:
        before.append((part_id, n_sources))
        n_sources += n
    starts = F.broadcast(spark.createDataFrame(before or [(0, 0)], "part long, start long"))
    number = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    weighed, folder = stored_at(listed.withColumn("part", part).join(starts, "part").select("source", number.alias("number"), "source_size", "rows").withColumn("weight", weight))
    remove_folder(spark, first)

    cap = F.col("source_size") * limit
    total, all_weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (total or 0) * share / (all_weight or 1.0), -1
    while True:
        over = F.col("weight") * level > cap
        capped, held, free = weighed.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if capped == full or not free:
            break
        level, full = ((total or 0) * share - (held or 0)) / free, capped
    return weighed.select("source", "number", "source_size", "rows", F.least(cap.cast("double"), F.col("weight") * level).alias("target")), folder, n_sources


@dataclass
class Row:
    """A document (or ``n`` equal ones) with its whole copies, and the fraction of one more; None if that is settled."""

    number: int
    leaf: int
    id: int | None
    size: int
    h: int
    n: int
    copies: int
    p: float | None
    u: float = field(default=0.0, compare=False)

    def settled(self, more: int, n: int | None = None) -> Row:
        return Row(self.number, self.leaf, self.id, self.size, self.h, self.n if n is None else n, self.copies + more, None)


def meet(a: Row, b: Row) -> tuple[list[Row], Row | None]:
    """Move words between two fractional documents until one is whole: those that are, and the other. The draw is b's."""
    a_down, a_up, b_down, b_up = a.p * a.size, (1 - a.p) * a.size, b.p * b.size, (1 - b.p) * b.size
    to_a, to_b = min(a_up, b_down), min(a_down, b_up)
    move = to_a if b.u * (to_a + to_b) < to_b else -to_b
    pa_, pb = a.p + move / a.size, b.p - move / b.size
    whole, left = [], None
    for row, p, bound in ((a, pa_, a_up if move > 0 else a_down), (b, pb, b_down if move > 0 else b_up)):
        if abs(move) >= bound or p <= TINY or p >= 1 - TINY:
            whole.append(row.settled(round(p)))
        else:
            left = Row(row.number, row.leaf, row.id, row.size, row.h, 1, row.copies, p, row.u)
    return whole, left


def opened(row: Row) -> tuple[list[Row], Row | None]:
    """A unit's rows that are whole by themselves, and one that is not."""
    if row.p is None or row.p <= TINY or row.size == 0:
        return [row.settled(0)], None
    more = row.n * row.p
    k = min(row.n, int(more + TINY))
    rest = more - k
    whole = [row.settled(1, k)] if k else []
    if k == row.n or rest <= TINY:
        return whole + ([row.settled(0, row.n - k)] if row.n > k else []), None
    if row.n - k > 1:
        whole.append(row.settled(0, row.n - k - 1))
    return whole, Row(row.number, row.leaf, row.id, row.size, row.h, 1, row.copies, rest, row.u)


def pivoted(rows: Iterator[Row]) -> Iterator[Row]:
    """Rows in order of number and leaf, with one fractional row left at most in each leaf."""
    held: Row | None = None
    for row in rows:
        if held is not None and (held.number, held.leaf) != (row.number, row.leaf):
            yield held
            held = None
        whole, left = opened(row)
        yield from whole
        if held is None:
            held = left
        elif left is not None:
            whole, held = meet(held, left)
            yield from whole
    if held is not None:
        yield held


def by_size(rows: list[Row], ratio: float, limit: int) -> Iterator[Row]:
    """Long documents of one source, class by class from the largest; what rounding leaves goes on to the next."""
    size = sum(r.size * r.n for r in rows)
    left = ratio * size
    rows = sorted(rows, key=lambda r: (-r.size.bit_length(), r.h, r.id is None, r.id or 0, r.size))
    for _, group in groupby(rows, key=lambda r: r.size.bit_length()):
        group = list(group)
        each = min(max(left / size, 0.0), float(limit)) if size else 0.0
        size -= sum(r.size * r.n for r in group)
        for r in group:
            r.leaf, r.copies, r.p = 0, int(each), each - int(each)
        for r in pivoted(iter(group)):
            done = r if r.p is None else r.settled(int(r.u < r.p))
            left -= done.size * done.n * done.copies
            yield done


ROW = "number long, leaf long, id long, size long, h long, n long, copies long, p double"
_TYPES = (pa.int64(),) * 7 + (pa.float64(),)
_NAMES = [x.split()[0] for x in ROW.split(",")]


def _read(batch: pa.RecordBatch) -> Iterator[Row]:
    """Rows of a batch with the columns of ROW and a draw."""
    for x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
        yield Row(*x)


def _written(rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=_NAMES)

    for r in rows:
        held.append((r.number, r.leaf, r.id, r.size, r.h, r.n, r.copies, r.p))
        if len(held) == 10_000:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _draw(level: int) -> Column:
    """A number from 0 to below 1 by the hash of a row."""
    return (F.shiftrightunsigned(F.xxhash64("h", F.lit(level)), 11).cast("double") / float(1 << 53)).alias("u")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    limit: int = LIMIT,
    share: float = 1.0,
    seed: int = SEED,
    leaf: int = LEAF,
    fan: int = FAN,
) -> DataFrame:
    """doc_id, source, h, size, source_size, target and copies, one row for each of ``docs``; ``share`` is the mix's size against all words."""
    spark = docs.sparkSession
    rows, rows_at = stored_at(units(docs, id_col, text_col, source_col, seed))
    sources, sources_at, n_sources = targets(rows, weights, limit, share)

    def known(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if n_sources <= FEW else table

    number = sources.select(F.col("source").alias("named"), "number", "source_size", "rows", "target")
    placed = rows.join(known(number), F.col("source").eqNullSafe(F.col("named")))
    long = F.col("size") * SHARE > F.col("source_size")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)

    def settle(group: pa.Table) -> pa.Table:
        each = group["ratio"][0].as_py()
        found = [r for b in group.drop_columns(["ratio"]).to_batches() for r in _read(b)]
        return pa.Table.from_batches(_written(by_size(found, each, limit)))

    blank = [F.lit(0).cast("long").alias("leaf"), "id", "size", "h", "n", F.lit(0).cast("long").alias("copies"), F.lit(None).cast("double").alias("p")]
    heavy, heavy_at = stored_at(placed.where(long).select("number", *blank, _draw(-1), ratio.alias("ratio")).groupBy("number").applyInArrow(settle, ROW))
    done = [heavy]

    taken = heavy.groupBy("number").agg(F.sum(F.col("size") * F.col("n")).alias("long_size"), F.sum(F.col("size") * F.col("n") * F.col("copies")).alias("long_taken"))
    rest = F.col("source_size") - F.coalesce("long_size", F.lit(0))
    aim = F.when(rest > 0, (F.col("target") - F.coalesce("long_taken", F.lit(0))) / rest).otherwise(0.0)
    aims = number.join(taken, "number", "left").withColumn("ratio", F.least(F.greatest(aim, F.lit(0.0)), F.lit(float(limit)))).withColumn("leaves", F.ceil(F.col("rows") / leaf).cast("long"))
    aims, aims_at = stored_at(aims.select("named", "number", "source_size", "ratio", "leaves"))
    start = rows.join(known(aims), F.col("source").eqNullSafe(F.col("named"))).where(~long)
    level = start.select("number", F.pmod("h", "leaves").alias("leaf"), "id", "size", "h", "n", F.floor("ratio").alias("copies"), (F.col("ratio") - F.floor("ratio")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _written(pivoted(r for b in batches for r in _read(b)))

    width, depth = aims.agg(F.max("leaves")).first()[0] or 1, 0
    while True:
        dealt = level.select("*", _draw(depth)).repartition("number", "leaf").sortWithinPartitions("number", "leaf", "h", "id", "size")
        out, _ = stored_at(dealt.mapInArrow(run, ROW))
        done.append(out.where("p is null"))
        level = out.where("p is not null")
        if width == 1:
            break
        width, depth = -(-width // fan), depth + 1
        level = level.withColumn("leaf", F.expr(f"leaf div {fan}"))
    done.append(level.withColumn("copies", F.col("copies") + (_draw(-2) < F.col("p")).cast("long")))

    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    many = 1 << 16  # equal rows that an array lists
    every = every.where("n > 0").withColumn("k", F.explode(F.expr(f"sequence(0L, (n - 1) div {many})")))
    every = every.withColumn("k", F.explode(F.expr(f"sequence(1L, least({many}L, n - k * {many}))")))
    named = sources.select("number", "source", "source_size", "target")
    remove_folder(spark, rows_at)
    remove_folder(spark, aims_at)
    return every.join(known(named), "number").select(F.col("id").alias("doc_id"), "source", "h", "size", "source_size", "target", "copies")


def drawn(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the plan of ``mix`` says."""
    copies = plan.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("h").alias("_h")).agg(F.sum("copies").cast("int").alias("_copies")).where("_copies > 0")
    h = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    once = docs.withColumn("_own", h).dropDuplicates([id_col, "source", "_own"])
    met = once.join(copies, F.col("_own").eqNullSafe(F.col("_h")) & F.col(id_col).eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")))
    return met.withColumn("_n", F.explode(F.expr("sequence(1, _copies)"))).select(*docs.columns)
