"""Ancestors and descendants among two sets of nodes, by a merge over intervals.

Nodes are numbered as in ``structure``: y is below x when x.pre < y.pre <= x.last.
Both sets come together by document, sorted by ``pre``, and one pass keeps the
ancestors that are still open on a stack: each descendant meets the stack, and so
only its own ancestors. A join with conditions on the numbers would compare
all pairs of a document.

The pass streams over a sorted partition: a batch's descendants of a node are a run of
rows, found by its numbers, and only the ancestors that are open at its end go on to the next.
So memory is a batch and the stack, as deep as the documents, and not a document or a group.
A node that is in both sets is no pair with itself. Repeated rows on either side give repeated
pairs; rows with a NULL key or number take no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs that go out at once.
ROWS = 20_000


def _documents(keys: list[pa.Array]) -> np.ndarray:
    """Numbers of documents; the rows of each stand together."""
    new = np.zeros(len(keys[0]), bool)
    for c in keys:
        if pa.types.is_nested(c.type):
            x = c.to_pylist()
            new[1:] |= np.array([a != b for a, b in zip(x[1:], x[:-1], strict=True)], bool)
        else:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def ancestor_pairs(ancestors: DataFrame, descendants: DataFrame, *keys: str, parents_only: bool = False, of_ancestor: Iterable[str] = (), of_descendant: Iterable[str] = ()) -> DataFrame:
    """(keys, ancestor, descendant): numbers of all pairs; with ``parents_only`` those that are one level apart.

    ``ancestors`` has the keys of a document, ``pre``, ``last`` and ``depth``, ``descendants`` the keys, ``pre`` and ``depth``.
    More columns of either side go with its nodes into the pairs, so that no join has to look them up.
    """
    n, high_with, low_with = len(keys), list(of_ancestor), list(of_descendant)
    names = [*keys, "ancestor", "descendant", *high_with, *low_with]
    if len({c.lower() for c in names}) < len(names):
        raise ValueError(f"rename columns that are named alike: {', '.join(names)}")
    number = lambda c: F.col(c).cast("int")
    level = number("depth") if parents_only else F.lit(0)
    none = lambda df, columns: [F.lit(None).cast(df.schema[c].dataType).alias(f"_{i}") for i, c in enumerate(columns)]
    own = lambda columns, start=0: [F.col(c).alias(f"_{start + i}") for i, c in enumerate(columns)]
    at = len(high_with)
    low = descendants.select(*keys, number("pre").alias("pre"), F.lit(0).alias("side"), F.lit(-1).alias("last"), level.alias("depth"), *none(ancestors, high_with), *own(low_with, at))
    later = [c.alias(f"_{at + i}") for i, c in enumerate(none(descendants, low_with))]
    high = ancestors.select(*keys, number("pre").alias("pre"), F.lit(1).alias("side"), number("last").alias("last"), level.alias("depth"), *own(high_with), *later)
    known = " and ".join(f"`{k}` is not null" for k in (*keys, "pre", "last", "depth"))
    dealt = low.unionByName(high).where(known).repartition(*keys).sortWithinPartitions(*keys, "pre")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.RecordBatch | None = None  # ancestors that are still open
        for batch in batches:
            if not batch.num_rows:
                continue
            if left is not None and left.num_rows:
                batch = pa.concat_batches([left, batch])
            pre, side, last, depth = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[n : n + 4])
            doc = _documents(batch.columns[:n])
            lows, highs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            least = min(int(pre.min()), int(last.min()))
            line = doc * (max(int(pre.max()), int(last.max())) - least + 1) - least  # documents one after another
            spots = (line + pre)[lows]
            start, stop = np.searchsorted(spots, (line + pre)[highs], "right"), np.searchsorted(spots, (line + last)[highs], "right")
            many = np.maximum(stop - start, 0)
            total = np.cumsum(many)
            edges = [0, *(np.flatnonzero(np.diff(total // ROWS)) + 1).tolist(), len(highs)]
            for a, e in zip(edges[:-1], edges[1:], strict=True):
                size = many[a:e]
                up = np.repeat(highs[a:e], size)
                down = lows[np.repeat(start[a:e] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                if parents_only:
                    near = depth[up] == depth[down] - 1
                    up, down = up[near], down[near]
                if len(up):
                    u, v = pa.array(up), pa.array(down)
                    columns = [*[c.take(u) for c in batch.columns[:n]], batch.column(n).take(u), batch.column(n).take(v)]
                    yield pa.RecordBatch.from_arrays([*columns, *[batch.column(n + 4 + i).take(u if i < at else v) for i in range(at + len(low_with))]], names=names)
            left = batch.take(pa.array(highs[(doc[highs] == doc[-1]) & (last[highs] >= pre[-1])]))

    fields = [T.StructField(f.name, f.dataType) for f in dealt.schema.fields[:n]]
    more = [T.StructField(c, df.schema[c].dataType) for df, columns in ((ancestors, high_with), (descendants, low_with)) for c in columns]
    return dealt.mapInArrow(run, T.StructType([*fields, T.StructField("ancestor", T.IntegerType()), T.StructField("descendant", T.IntegerType()), *more]))
