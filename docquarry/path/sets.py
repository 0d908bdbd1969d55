"""Many paths over documents in one walk, and paths that are themselves data.

A set of paths becomes one trie of steps, so that what paths have in common is
walked once, for all documents of a batch together. The walk is over the node
columns of ``operators.structure``: a step turns an array of rows into an
array of rows, by sorted keys for names, by runs of children for places, and by
intervals for descents. So matches come in the order of the document (members
too, a descent in the order of the containers), numbers keep their spelling, and no depth
is too great.

``find_all`` takes paths from a list or a table of at most ``MOST`` paths, which go to
all executors; ``find`` takes the path from a column, so that each row may have its
own. ``register`` makes the latter a function of SQL. All are narrow. What the
steps find is what ``path.nodes`` finds, repeated matches too.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.structure import KINDS, NODE, Nodes, batches, index, refuse_clashes
from .syntax import PathError, parse
from .syntax import text as written_as

MOST = 10_000
MATCH = T.StructType([T.StructField("path", T.StringType()), T.StructField("at", T.IntegerType()), *NODE.fields])


_ORDER = {"==": np.equal, "!=": np.not_equal, "<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}


def _compared(op: str, x: tuple, y: tuple) -> bool:
    """Two values, each with its kind."""
    if op in ("==", "!="):
        return (x == y) == (op == "==")
    if x[0] != y[0] or x[0] not in ("number", "string") or type(x[1]) is not type(y[1]):
        return False
    a, b = (z[1].encode("utf-16-be") if isinstance(z[1], str) and x[0] == "string" else z[1] for z in (x, y))  # texts in order of UTF-16 units
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


@dataclass
class Trie:
    """Steps to what follows them, and the paths that end here."""

    ends: list[str] = field(default_factory=list)
    next: dict[tuple, Trie] = field(default_factory=dict)


def trie(paths: Iterable[str]) -> Trie:
    """One trie for different paths; a path that can't be read raises PathError."""
    root = Trie()
    for path in dict.fromkeys(paths):
        at = root
        for step in parse(path):
            at = at.next.setdefault(step, Trie())
        at.ends.append(path)
    return root


@lru_cache(4096)
def one(path: str) -> Trie:
    return trie([path])


def taken(n: int, start: int | None, stop: int | None, step: int | None) -> range:
    """The places that a slice takes of n elements."""
    step = 1 if step is None else step
    if step == 0 or n == 0:
        return range(0)
    place = lambda x: x if x >= 0 else n + x
    if step > 0:
        lo, hi = (0 if start is None else min(max(place(start), 0), n)), (n if stop is None else min(max(place(stop), 0), n))
    else:
        lo, hi = (n - 1 if start is None else max(min(place(start), n - 1), 0)), (-1 if stop is None else max(place(stop), -1))
    return range(lo, hi, step)


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of the runs, one after another, and which run each is of."""
    of = np.repeat(np.arange(len(counts)), counts)
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum())), of


class Walk:
    """Steps over the rows of some documents. Each gives rows and, for each, the place of the row that it came from."""

    def __init__(self, nodes: Nodes, texts: list[bytes]):
        self.nodes, self.texts = nodes, texts
        n = len(nodes.pre)
        self.rows = np.arange(n)
        self.head = self.rows - nodes.pre
        parent = np.where(nodes.parent < 0, -1, self.head + nodes.parent)
        self.children = np.argsort(parent, kind="stable")  # roots, then each node's in order
        counts = np.bincount(parent[parent >= 0], minlength=n) if n else np.zeros(0, np.int64)
        self.count = counts
        self.first = int((parent < 0).sum()) + np.cumsum(counts) - counts
        self.parent = parent

    @cached_property
    def names(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """Numbers of names, and sorted keys of parent and name with their rows."""
        number = {x: i for i, x in enumerate(self.nodes.names)}
        ids = self.nodes.name_id
        named = np.flatnonzero(ids >= 0)
        keys = self.parent[named] * len(number) + ids[named]
        order = np.argsort(keys)
        return number, keys[order], named[order]

    @cached_property
    def decoded(self) -> dict[int, str]:
        return {}

    @cached_property
    def real(self) -> np.ndarray:
        """Each number as a double."""
        out = np.full(len(self.rows), np.nan)
        at = np.flatnonzero(self.nodes.kind == 3)
        spelled = self.nodes.column("text", at)
        try:
            out[at] = spelled.cast(pa.float64())
        except pa.ArrowInvalid:  # beyond doubles
            out[at] = [float(x) for x in spelled.to_pylist()]
        return out

    def roots(self, docs: np.ndarray | None = None) -> np.ndarray:
        found = self.rows[self.nodes.pre == 0]
        return found if docs is None else found[docs[self.nodes.doc[found]]]

    def member(self, rows: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        number, keys, named = self.names
        if name not in number or not len(keys):
            return rows[:0], rows[:0]
        want = rows * len(number) + number[name]
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == want)
        return named[at[hit]], hit

    def step(self, rows: np.ndarray, step: tuple) -> tuple[np.ndarray, np.ndarray]:
        is_array = self.nodes.kind[rows] == 1
        match step:
            case ("name", name):
                return self.member(rows, name)
            case ("index", i):
                place = i + np.where(i < 0, self.count[rows], 0)
                hit = np.flatnonzero(is_array & (place >= 0) & (place < self.count[rows]))
                return self.children[self.first[rows[hit]] + place[hit]], hit
            case ("last",):
                return self.step(rows, ("index", -1))
            case ("all",):
                at, of = _spread(self.first[rows], self.count[rows])
                return self.children[at], of
            case ("slice", *parts):
                hit = np.flatnonzero(is_array)
                sizes, size = np.unique(self.count[rows[hit]], return_inverse=True)
                each = [taken(n, *parts) for n in sizes.tolist()]
                start, many, by = (np.array([f(x) for x in each], np.int64)[size] for f in (lambda x: x.start, len, lambda x: x.step))
                nth, of = _spread(np.zeros(len(hit), np.int64), many)
                return self.children[self.first[rows[hit[of]]] + start[of] + by[of] * nth], hit[of]
            case ("filter", test):
                hit = np.flatnonzero(is_array)
                at, of = _spread(self.first[rows[hit]], self.count[rows[hit]])
                below = self.children[at]
                ok = self.hold(test, below)
                return below[ok], hit[of[ok]]
            case ("union", steps):
                found = [self.step(rows, s) for s in steps]
                below, of = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(of, kind="stable")
                return below[order], of[order]
            case ("deep", target) if target[0] in ("name", "all", "index"):
                inside, of = _spread(rows, self.nodes.last[rows] - self.nodes.pre[rows] + 1)
                below, at = self.step(inside, target)
                return below, of[at]
        return rows[:0], rows[:0]

    def value(self, row: int | None):
        """What a filter compares: ("number", x), ("null",) also for what is absent, or the kind and the value."""
        if row is None or self.nodes.kind[row] == 5:
            return ("null", None)
        kind, text = KINDS[self.nodes.kind[row]], self.nodes.text[row]
        if kind == "number":
            x = float(text)
            return (kind, x if math.isfinite(x) else text)
        if kind == "boolean":
            return (kind, text == "true")
        if kind == "string":
            return (kind, text)
        d = int(self.nodes.doc[row])
        if d not in self.decoded:
            self.decoded[d] = self.texts[d].decode()
        a = int(self.nodes.offset[row])
        return (kind, json.loads(self.decoded[d][a : a + int(self.nodes.length[row])]))

    def below(self, rows: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        """What a way of names leads to from each row, -1 where to nothing."""
        out, of = np.full(len(rows), -1), np.arange(len(rows))
        for name in names:
            rows, hit = self.member(rows, name)
            of = of[hit]
        out[of] = rows
        return out

    def operand(self, o: tuple, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """For each row the kind, as a place in KINDS, and the row that holds the value, if it is no literal."""
        if o[0] == "value":
            x = o[1]
            return np.full(len(rows), 5 if x is None else 4 if isinstance(x, bool) else 3 if isinstance(x, float) else 2), None
        at = self.below(rows, o[1])
        return np.where(at < 0, 5, self.nodes.kind[at]), at

    def single(self, o: tuple, kind: int, at: np.ndarray | None, i: int):
        return (KINDS[kind], o[1]) if at is None else self.value(int(at[i]) if at[i] >= 0 else None)

    def compare(self, op: str, a: tuple, b: tuple, rows: np.ndarray) -> np.ndarray:
        (p, at), (q, to) = self.operand(a, rows), self.operand(b, rows)
        out = np.full(len(rows), op == "!=")
        alike = p == q
        if op in ("==", "!="):
            out[alike & (p == 5)] = op == "=="
            left = alike & (p != 5)
        else:
            left = alike & ((p == 2) | (p == 3))
        x, y = (np.full(len(rows), o[1]) if r is None and isinstance(o[1], float) else np.where(k == 3, self.real[r], np.nan) if r is not None else np.full(len(rows), np.nan) for o, k, r in ((a, p, at), (b, q, to)))
        fit = left & (p == 3) & np.isfinite(x) & np.isfinite(y)
        out[fit] = _ORDER[op](x[fit], y[fit])
        left &= ~fit
        known: dict[tuple, bool] = {}
        for i in np.flatnonzero(left).tolist():
            u, v = self.single(a, int(p[i]), at, i), self.single(b, int(q[i]), to, i)
            if u[0] not in ("string", "boolean"):
                out[i] = _compared(op, u, v)
                continue
            if (u, v) not in known:
                known[u, v] = _compared(op, u, v)
            out[i] = known[u, v]
        return out

    def hold(self, test: tuple, rows: np.ndarray) -> np.ndarray:
        """Which of the rows stand a test."""
        match test:
            case ("or" | "and" as way, a, b):
                out = self.hold(a, rows)
                rest = np.flatnonzero(out == (way == "and"))
                out[rest] = self.hold(b, rows[rest])
                return out
            case ("not", a):
                return ~self.hold(a, rows)
            case ("has", names):
                return self.below(rows, names) >= 0
            case ("compare", op, a, b):
                return self.compare(op, a, b, rows)
        return np.ones(len(rows), bool)

    def matches(self, t: Trie, rows: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """(path, rows in order) of all paths of a trie, from the given roots."""
        for path in t.ends:
            yield path, rows
        for step, below in t.next.items():
            yield from self.matches(below, self.step(rows, step)[0])


def _out(part: pa.RecordBatch, kept: int, nodes: Nodes, found: Iterable[tuple[str, np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    for path, rows in found:
        if len(rows):
            doc = nodes.doc[rows]
            new = {"path": lambda path=path, rows=rows: pa.repeat(path, len(rows)), "at": lambda doc=doc: _counted(doc)}
            of = pa.array(doc)
            yield pa.RecordBatch.from_arrays([*[part.column(i).take(of) for i in range(kept)], *[new[c]() if c in new else nodes.column(c, rows) for c in names[kept:]]], names=names)


def _counted(doc: np.ndarray) -> pa.Array:
    """Numbers of the rows of each document, from 0."""
    head = np.flatnonzero(np.diff(doc, prepend=-1))
    return pa.array(np.arange(len(doc)) - np.repeat(head, np.diff(np.append(head, len(doc)))), pa.int32())


def _texts(part: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]


def find_all(df: DataFrame, text: str, paths: Iterable[str] | DataFrame, *keep: str, columns: Iterable[str] = MATCH.names) -> DataFrame:
    """(keep, path, at, and the columns of a node) for each match of each path; ``at`` counts a path's matches in a document.

    A table of paths has them in its first column; more than ``MOST`` are refused. ``columns`` are those of ``MATCH`` that are made.
    """
    columns = list(columns)
    if isinstance(paths, DataFrame):
        paths = [r[0] for r in paths.select(paths.columns[0]).dropna().distinct().limit(MOST + 1).collect()]
    paths = list(dict.fromkeys(paths))
    if len(paths) > MOST:
        raise ValueError(f"more than {MOST} paths")
    refuse_clashes(keep, columns)
    compiled, n, names = trie(paths), len(keep), [*keep, *columns]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, nodes in batches(source, n):
            walk = Walk(nodes, _texts(part, n))
            yield from _out(part, n, nodes, walk.matches(compiled, walk.roots()), names)

    narrow = df.select(*keep, F.col(text).cast("string"))
    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:n], *[MATCH[c] for c in columns]]))


def find(df: DataFrame, text: str, path: str, *keep: str) -> DataFrame:
    """The same for the path that each row has in a column; a row without one has no matches, and one that can't be read fails the query."""
    refuse_clashes(keep, MATCH.names)
    n, names = len(keep), [*keep, *MATCH.names]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, nodes in batches(source, n):
            walk = Walk(nodes, _texts(part, n))
            asked = np.array(part.column(n + 1).to_pylist(), object)
            for p in {x for x in asked.tolist() if x is not None}:
                yield from _out(part, n, nodes, walk.matches(one(p), walk.roots(asked == p)), names)

    narrow = df.select(*keep, F.col(text).cast("string"), F.col(path).cast("string"))
    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:n], *MATCH.fields]))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _found(texts: pa.Array, paths: pa.Array) -> pa.Array:
    raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    nodes = index(raw)
    walk = Walk(nodes, raw)
    asked = np.array(paths.to_pylist(), object)
    out: list[list[str] | None] = [[] if ok and p is not None else None for ok, p in zip(nodes.good.tolist(), asked.tolist(), strict=True)]
    decoded: dict[int, str] = {}
    for p in {x for x in asked.tolist() if x is not None}:
        for _, rows in walk.matches(one(p), walk.roots(asked == p)):
            for d, a, n in zip(nodes.doc[rows].tolist(), nodes.offset[rows].tolist(), nodes.length[rows].tolist(), strict=True):
                if d not in decoded:
                    decoded[d] = raw[d].decode()
                out[d].append(decoded[d][a : a + n])
    return pa.array(out, pa.list_(pa.string()))


def found(text: Column, path: Column) -> Column:
    """The matches as JSON texts, as they are spelled and in their order; NULL if the text is no document or the path is NULL."""
    return _found(text, path)


_TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("position", T.IntegerType())])


@F.arrow_udf(_TEXT)
def _described(paths: pa.Array) -> pa.Array:
    known: dict[str, dict] = {}
    for p in set(paths.to_pylist()) - {None}:
        try:
            known[p] = {"text": written_as(parse(p)), "position": -1}
        except PathError as e:
            known[p] = {"text": None, "position": e.position}
    return pa.array([known.get(p) for p in paths.to_pylist()], pa.struct([("text", pa.string()), ("position", pa.int32())]))


def described(path: Column) -> Column:
    """The canonical text of a path, or the position where it can't be read; -1 if it can."""
    return _described(path)


def register(spark: SparkSession, name: str = "json_find") -> None:
    """``json_find(text, path)`` for SQL."""
    spark.udf.register(name, _found)
