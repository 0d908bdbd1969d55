"""Sets of paths against a slow evaluator that keeps the order of the document."""

import json
import random
import time

import plain_json_path as plain
import pytest
from pyspark.sql import functions as F

from docquarry.operators.structure import index
from docquarry.path import PathError, parse, sets
from store_document import STORE as GOESSNER

PATHS = [
    "$", "$.store", "$.store.book[*].author", "$..author", "$.store.*", "$.store..price", "$..book[2]", "$..book[-1]", "$..book[(@.length-1)]", "$..book[0,1]", "$..book[:2]", "$..book[::-1]", "$..book[-2:]", "$..*", "$..[0]",
    "$..book[?(@.isbn)]", "$..book[?(@.price < 10)]", "$.store.book[?(@.price > 8 && !(@.category == 'fiction'))].title", "$['store']['bicycle','book']", "$.store.book[?(@.isbn == null)]", "$.store.book[?(@.category != 'fiction' || @.price >= 22.99)]",
    "$.none", "$.store.book[9]", "$.store.book[::0]", "$.store.book[3:0:-2]", "$..a..a", "$[*][*]", "$[?(@ == 1)]", "$[?(@.x == @.y)]", "$.store.book[1:].price",
]
DOCS = [GOESSNER, '[1,[2,3,[4]],{"a":{"a":1,"b":[5,6]}},{"x":[1],"y":[1.0]},{"x":{"p":1,"q":2},"y":{"q":2,"p":1}},{"x":1,"y":"1"}]', "[]", "{}", '"text"', '{"b":{"a":[{"a":1}]},"a":{"a":{"a":null}}}', "{bad", '{"store":{"book":{"price":1}}}']


def in_order(x):
    return list(x) if isinstance(x, list) else list(x.values()) if isinstance(x, dict) else []


def evaluate(steps, x):
    if not steps:
        return [x]
    s, rest = steps[0], steps[1:]
    if s[0] == "deep":
        if s[1][0] not in ("name", "all", "index"):
            return []
        found = in_order(x) if s[1][0] == "all" else plain.step(s[1], x)
        out = [z for y in found for z in evaluate(rest, y)]
        return out + [z for c in in_order(x) for z in evaluate(steps, c)]
    found = in_order(x) if s[0] == "all" else [z for part in s[1] for z in plain.step(part, x)] if s[0] == "union" else plain.step(s, x)
    return [z for y in found for z in evaluate(rest, y)]


def matched(text, nodes, rows):
    return [json.loads(text[int(nodes.offset[r]) : int(nodes.offset[r] + nodes.length[r])]) for r in rows]


def test_one_walk_finds_what_each_path_finds():
    raw = [d.encode() for d in DOCS]
    nodes = index(raw)
    walk = sets.Walk(nodes, raw)
    found = dict(walk.matches(sets.trie(PATHS), walk.roots()))
    assert set(found) == set(PATHS)
    for d, text in enumerate(DOCS):
        for p in PATHS:
            rows = [r for r in found[p].tolist() if nodes.doc[r] == d]
            assert matched(text, nodes, rows) == (evaluate(parse(p), json.loads(text)) if text != "{bad" else []), (p, text)


def test_paths_that_start_alike_share_a_trie():
    t = sets.trie(["$.a.b", "$.a.c", "$.a", "$['a'].b", "$.a.b"])
    assert len(t.next) == 1
    [a] = t.next.values()
    assert a.ends == ["$.a"]
    assert sorted(x for n in a.next.values() for x in n.ends) == ["$.a.b", "$.a.c", "$['a'].b"]


def test_slices_of_every_kind():
    for n in range(6):
        for a in (None, -7, -2, -1, 0, 1, 3, 7):
            for b in (None, -7, -2, 0, 2, 7):
                for c in (None, -3, -1, 0, 1, 2):
                    assert list(sets.taken(n, a, b, c)) == plain.step(("slice", a, b, c), list(range(n)))


def test_random_documents():
    rng = random.Random(4)

    def some(depth=0):
        k = rng.random()
        if depth > 4 or k < 0.3:
            return rng.choice([1, 2.5, "a", None, True])
        return [some(depth + 1) for _ in range(rng.randint(0, 4))] if k < 0.6 else {n: some(depth + 1) for n in rng.sample("abc", rng.randint(0, 3))}

    docs = [json.dumps(some()) for _ in range(150)]
    paths = ["$..a", "$..*", "$.a..b", "$[*].a", "$..[1]", "$[?(@.a)]", "$[?(@.a == @.b)]", "$[?(@.b > 1)].b", "$[-2:]", "$..a[*]", "$[0,1].a", "$.*.*"]
    raw = [d.encode() for d in docs]
    nodes = index(raw)
    walk = sets.Walk(nodes, raw)
    for p, rows in walk.matches(sets.trie(paths), walk.roots()):
        for d, text in enumerate(docs):
            assert matched(text, nodes, [r for r in rows.tolist() if nodes.doc[r] == d]) == evaluate(parse(p), json.loads(text)), (p, text)


def test_tables(spark):
    df = spark.createDataFrame([(i, d, PATHS[i]) for i, d in enumerate(DOCS)] + [(90, None, "$"), (91, "[1]", None)], "id int, doc string, path string")
    table = spark.createDataFrame([(p,) for p in PATHS] + [(None,), ("$",)], "path string")
    found = sets.find_all(df, "doc", table, "id")
    assert found.columns == ["id", *sets.MATCH.names]
    assert found.count() == sum(len(evaluate(parse(p), json.loads(d))) for d in [*DOCS, "[1]"] if d != "{bad" for p in PATHS)
    for p in ("$..*", "$.store.book[*].author"):
        ats = [r["at"] for r in found.where((F.col("path") == p) & (F.col("id") == 0)).orderBy("at").collect()]
        assert ats == list(range(len(evaluate(parse(p), json.loads(GOESSNER)))))
    own = sets.find(df, "doc", "path", "id").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in own} == {i: n for i, d in enumerate(DOCS) if d != "{bad" and (n := len(evaluate(parse(PATHS[i]), json.loads(d))))}


def test_sql(spark):
    sets.register(spark)
    spark.createDataFrame([(1, '{"a":[1.0,{"b":"x"}]}', "$.a[*]"), (2, "{", "$"), (3, None, "$"), (4, "1", None), (5, "[]", "$.a")], "id int, doc string, path string").createOrReplaceTempView("own_paths")
    got = {r.id: r.f for r in spark.sql("select id, json_find(doc, path) as f from own_paths").collect()}
    assert got == {1: ["1.0", '{"b":"x"}'], 2: None, 3: None, 4: None, 5: []}


def test_refusals(spark, monkeypatch):
    df = spark.createDataFrame([("{}", "$[")], "doc string, path string")
    with pytest.raises(PathError):
        sets.find_all(df, "doc", ["$["])
    with pytest.raises(Exception, match="bracket|unreadable"):
        sets.find(df, "doc", "path").collect()
    monkeypatch.setattr(sets, "MOST", 1)
    with pytest.raises(ValueError, match="more than 1"):
        sets.find_all(df, "doc", spark.createDataFrame([("$",), ("$.a",)], "path string"))
    rows = sets.described(F.col("p"))
    got = spark.createDataFrame([("$['a'].b",), ("$[",), (None,)], "p string").select(rows.alias("x")).collect()
    assert [r.x and (r.x.text, r.x.position) for r in got] == [("$.a.b", -1), (None, 1), None]


def test_chosen_columns_of_matches(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, doc string")
    whole = sets.find_all(df, "doc", PATHS, "id")
    some = sets.find_all(df, "doc", PATHS, "id", columns=("text", "path", "at"))
    assert some.columns == ["id", "text", "path", "at"]
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.select(some.columns).collect()))


def test_many_filters_over_many_elements_take_no_python_for_each():
    """A step of Python for each element and filter took minutes."""
    raw = [json.dumps({"items": [{"q": i % 50, "s": "xy"[i % 2], "big": 10**i if i == 400 else i} for i in range(k, k + 1000)]}).encode() for k in range(0, 150_000, 1000)]
    nodes = index(raw)
    walk = sets.Walk(nodes, raw)
    began = time.process_time()
    found = {p: len(rows) for p, rows in walk.matches(sets.trie([f"$.items[?(@.q < {k} && @.s == 'x')]" for k in range(20)] + ["$.items[?(@.big > 10)]"]), walk.roots())}
    assert time.process_time() - began < 25
    assert [found[f"$.items[?(@.q < {k} && @.s == 'x')]"] for k in range(20)] == [3000 * ((k + 1) // 2) for k in range(20)]
    assert found["$.items[?(@.big > 10)]"] == 150_000 - 12
