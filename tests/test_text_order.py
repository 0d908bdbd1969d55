"""Texts compare by UTF-16 units in filters: a character above U+FFFF comes before U+E000 and what follows."""

import json

from pyspark.sql import functions as F

from docquarry.functions.variant import parse_tolerant
from docquarry.operators.structure import index
from docquarry.path import nodes, parse, sets

WORDS = ["a", "퟿", "", "￮", "😀", "😀a", "", "a😀", "a"]


def test_filters_on_both_forms(spark):
    doc = json.dumps([{"x": a, "y": b} for a in WORDS for b in WORDS], ensure_ascii=False)
    raw = [doc.encode()]
    n = index(raw)
    walk = sets.Walk(n, raw)
    df = spark.createDataFrame([(doc,)], "doc string").select(parse_tolerant(F.col("doc")).alias("v"))
    unit = lambda t: t.encode("utf-16-be")
    for path, keep in (
        ("$[?(@.x < @.y)]", lambda o: unit(o["x"]) < unit(o["y"])),
        ("$[?(@.x >= @.y)]", lambda o: unit(o["x"]) >= unit(o["y"])),
        ("$[?(@.x < '')]", lambda o: unit(o["x"]) < unit("")),
        ("$[?(@.x > '😀')]", lambda o: unit(o["x"]) > unit("😀")),
        ("$[?('😀' <= @.x)]", lambda o: unit("😀") <= unit(o["x"])),
        ("$[?(@.x <= 'a')]", lambda o: unit(o["x"]) <= unit("a")),
        ("$[?('😀' < '')]", lambda o: True),
    ):
        want = [o for o in json.loads(doc) if keep(o)]
        got = [json.loads(x) for x in df.select(F.transform(nodes(F.col("v"), path), lambda x: F.to_json(x)).alias("x")).first().x]
        assert got == want, path
        rows = walk.step(walk.roots(), parse(path)[0])[0]
        assert [json.loads(doc[int(n.offset[r]) : int(n.offset[r] + n.length[r])]) for r in rows] == want, path
