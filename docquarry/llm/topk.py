"""Exact top-k search by inner product, with a uniform threshold in three phases.

The dimensions are dealt into ``parts`` lists, and a row's score is the sum of
its local scores, one from each list. Phase one gathers local score lists from
a share of the rows: the full scores of each list's k best rows give a cutoff,
the k-th best of them, which no row of the answer falls below (whatever the
share). Phase two sends the cutoff to all rows' lists, and each list returns
the rows whose local score reaches cutoff / parts; a row that no list returns
has a sum below the cutoff. Phase three resolves the returned rows, and only
these, in the task that holds their lists: the sum of the local scores is the
score, and of each block of rows a query's k best go on.

Vectors travel in blocks of ``BLOCK`` rows, queries in blocks of about
``QUERIES``; every block of queries meets every block of vectors, ``GROUP`` of
them at a time, so that no key of the join holds more and nothing that grows
with the input is broadcast. A component x counts as floor(256 x), as double.

A vector that is null or has a null or non-finite component takes no part, as
query or candidate; one without an id neither. Shorter vectors count as padded
with zeros; an empty vector scores 0 against all. Rows that repeat an id are
one vector to its queries: the best of them counts. Equal scores go to the
smaller id. An empty table gives an empty table; only the id and vector
columns are read, so no other name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
PARTS = 4
BLOCK = 4096
QUERIES = 2048
#: Blocks of vectors that meet a block of queries under one key, and queries that a task multiplies at once.
GROUP, SUB = 8, 256
#: Sums below this are exact in doubles.
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<bigint>) of the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("bigint"))
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    fit = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad
    return vectors.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of 64-bit integers, padded with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _blocks(rows: DataFrame, size: int, width: int) -> DataFrame:
    """(block, ids, matrix) of at most ``size`` rows each; matrix holds 64-bit integers by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, m = part.column(0).to_numpy().astype("<i8"), _matrix(part.column(1), width).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids.tobytes()]), pa.array([m.tobytes()])], names=["block", "ids", "matrix"])
                block += 1

    return rows.select("vec_id", "v").mapInArrow(run, "block long, ids binary, matrix binary")


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of q with all of v."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    exact = q.astype(object) @ v.T.astype(object)
    return exact.astype(np.int64)  # raises where a score is no long


def total(lists: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sums of the local scores at places (a, b)."""
    at = [x[a, b] for x in lists]
    most = max(max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in at)
    if most * len(at) <= np.iinfo(np.int64).max:
        return np.sum(at, axis=0, dtype=np.int64)
    return sum(x.astype(object) for x in at).astype(np.int64)  # raises where a score is no long


def gathered(lists: list[np.ndarray], own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase one: places of each query's k best local scores in each list, but for the query's own rows."""
    found = np.zeros(own.shape, bool)
    rows, width = own.shape
    for local in lists:
        free = np.where(own, np.iinfo(np.int64).min, local)
        best = np.argpartition(free, width - k, axis=1)[:, width - k :] if k < width else np.broadcast_to(np.arange(width), (rows, width))
        found[np.arange(rows)[:, None], best] = True
    return np.nonzero(found & ~own)


def returned(lists: list[np.ndarray], own: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase two: places that some list returns; the threshold is taken a little low, so that rounding loses none."""
    least = cutoff / len(lists)
    least = np.where(np.isfinite(least), least - np.abs(least) * 1e-12, least)[:, None]
    found = np.zeros(own.shape, bool)
    for local in lists:
        found |= local >= least
    return np.nonzero(found & ~own)


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, ties to the smaller id; of rows with one id the best counts."""
    order = np.lexsort((-scores, ids, query))
    first = np.ones(len(order), bool)
    first[1:] = (query[order[1:]] != query[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])
    order = order[first]
    order = order[np.lexsort((ids[order], -scores[order], query[order]))]
    starts = np.flatnonzero(np.concatenate([[True], query[order[1:]] != query[order[:-1]]])) if len(order) else np.empty(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def meeting(q: np.ndarray, v: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, cutoff: np.ndarray | None, parts: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score) of the k best places of each query in a block, and how many places were resolved for that.

    Without a cutoff these are phase one's; with one, phases two and three.
    """
    edges = [v.shape[1] * i // parts for i in range(parts + 1)]
    lists = [products(q[:, a:b], v[:, a:b]) for a, b in zip(edges, edges[1:], strict=False) if b > a] or [np.zeros((len(q), len(v)), np.int64)]
    own = q_ids[:, None] == ids[None, :]
    a, b = gathered(lists, own, k) if cutoff is None else returned(lists, own, cutoff)
    scores = total(lists, a, b)
    kept = best(a, ids[b], scores, k)
    return a[kept], b[kept], scores[kept], len(a)


def _pairs(blocks: DataFrame, queries: DataFrame, keys: list[str], width: int, parts: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of blocks and query blocks with equal keys; a query block without cutoffs is in phase one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, matrix, q_ids, q_matrix, cutoffs = (batch.column(c)[i].as_py() for c in range(5))
                ids, q_ids = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                v, q = np.frombuffer(matrix, "<i8").reshape(len(ids), width), np.frombuffer(q_matrix, "<i8").reshape(len(q_ids), width)
                cutoff = None if cutoffs is None else np.frombuffer(cutoffs, "<f8")
                for at in range(0, len(q_ids), SUB):
                    some = slice(at, at + SUB)
                    a, b, scores, _ = meeting(q[some], v, q_ids[some], ids, None if cutoff is None else cutoff[some], parts, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[some][a]), pa.array(ids[b]), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return blocks.join(queries, keys).select("ids", "matrix", "q_ids", "q_matrix", "cutoffs").mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with their rank."""
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, parts: int = PARTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each row whose id is divisible by ``every``."""
    rows = quantised(vectors, id_col, vector_col)
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    held = stored(_blocks(rows, BLOCK, width))
    groups = max(1, -(-held.count() // GROUP))
    blocks = held.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).drop("block")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))  # one query for an id
    dealt = stored(asked.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).cast("int")))
    n_queries = max(1, -(-dealt.count() // QUERIES))
    dealt = dealt.withColumn("query_block", F.col("query_block") % n_queries)

    def gather(part: pa.Table) -> pa.Table:
        ids, matrix = part.column("vec_id").to_numpy().astype("<i8"), _matrix(part.column("v"), width).astype("<i8")
        cutoffs = None
        if "cutoff" in part.column_names:
            cutoffs = np.array([-np.inf if x is None else x for x in part.column("cutoff").to_pylist()], "<f8").tobytes()
        block = part.column("query_block")[0].as_py()
        columns = [pa.array([block], pa.int32()), pa.array([ids.tobytes()]), pa.array([matrix.tobytes()]), pa.array([cutoffs], pa.binary())]
        return pa.table(columns, names=["query_block", "q_ids", "q_matrix", "cutoffs"])

    def query_blocks(queries: DataFrame) -> DataFrame:
        """Queries beyond ``QUERIES`` in a block by chance stay in it."""
        return queries.groupBy("query_block").applyInArrow(gather, "query_block int, q_ids binary, q_matrix binary, cutoffs binary")

    started = query_blocks(dealt).withColumn("group", F.pmod("query_block", F.lit(groups)))
    sampled = _ranked(_pairs(blocks, started, ["group"], width, parts, k), k)
    cutoffs = sampled.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("cutoff"))
    told = query_blocks(dealt.join(cutoffs, "vec_id", "left")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = blocks.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    return _ranked(_pairs(met, told, ["query_block", "group"], width, parts, k), k).select("query_id", "rank", "vec_id", "score")
