"""Validation by a worklist against the expression, on recursion that the expression can't follow, and schema rules in the executors."""

import json

import pytest
from pyspark.sql import functions as F

from docquarry.functions.variant import parse_tolerant
from docquarry.operators import jtd, schemas, worklist
from docquarry.plans.checks import RULES

SCHEMAS = [
    {"properties": {"a": {"type": "uint8"}, "b": {"enum": ["x", "y"]}}, "optionalProperties": {"c": {"elements": {"type": "timestamp"}}}},
    {"discriminator": "t", "mapping": {"p": {"properties": {"v": {"type": "float32"}}}, "q": {"optionalProperties": {"w": {"values": {"type": "boolean", "nullable": True}}}, "additionalProperties": True}}},
    {"definitions": {"n": {"properties": {"v": {"type": "string"}}, "optionalProperties": {"l": {"ref": "n"}, "r": {"ref": "m"}}}, "m": {"ref": "n", "nullable": True}}, "ref": "n"},
    {"elements": {"discriminator": "k", "mapping": {"a": {"properties": {"x": {"properties": {}}}}}}, "nullable": True},
    {"values": {"elements": {"type": "int8"}}},
    {"optionalProperties": {"a/b": {"type": "string"}}},
    {},
]
INSTANCES = [
    '{"a":1,"b":"x"}', '{"a":256,"b":"z","d":1,"c":["x",1,"2020-01-01T00:00:00Z","2020-01-01T00:00:60Z"]}', "[]", "null", '{"t":"p","v":"x"}', '{"t":"q","w":{"a":null,"b":1},"z":1}', '{"t":"r"}', '{"t":1}', "{}",
    '{"v":"a","l":{"v":1,"r":null},"r":{"v":"b","l":null}}', '[1,-129,1.5,"x",1e1]', "3", '[{"k":"a","x":{}},{"k":"a","x":{"y":1}},{"k":"a"},{"k":"b"},{},1]', '{"p":[1,128],"q":{},"r":[]}', '{"a/b":1,"c":2}', '"x"',
]


def cases(spark):
    return spark.createDataFrame([(i, json.dumps(s), x) for i, (s, x) in enumerate((s, x) for s in SCHEMAS for x in INSTANCES)], "id int, schema string, instance string")


def test_as_the_expression(spark):
    df = cases(spark)
    got = {r.id: r for r in worklist.validate(df).collect()}
    assert len(got) == len(SCHEMAS) * len(INSTANCES)
    for s in map(json.dumps, SCHEMAS):
        want = df.where(F.col("schema") == s).select("id", jtd.errors(parse_tolerant(F.col("instance")), jtd.compile_schema(s)).alias("e"))
        for r in want.collect():
            assert got[r.id].errors == r.e, (s, INSTANCES[r.id % len(INSTANCES)])
            assert got[r.id].valid == (r.e == [])


LIST = '{"definitions":{"n":{"properties":{"v":{"type":"int8"}},"optionalProperties":{"next":{"ref":"n"}}}},"ref":"n"}'
TREE = '{"definitions":{"n":{"optionalProperties":{"l":{"ref":"n"},"m":{"ref":"n"},"r":{"ref":"n"},"v":{"type":"string"}}}},"ref":"n"}'
ARRAYS = '{"definitions":{"a":{"elements":{"ref":"a"}}},"ref":"a"}'


def tree(depth, leaf):
    return leaf if depth == 0 else {"l": tree(depth - 1, {}), "r": tree(depth - 1, leaf)}


def test_recursion_of_any_depth(spark):
    long = '{"v":1,"next":' * 200 + '{"v":1}' + "}" * 200
    late = '{"v":1,"next":' * 60 + '{"v":"x"}' + "}" * 60
    rows = [(1, LIST, long), (2, LIST, late), (3, TREE, json.dumps(tree(12, {"v": "x"}))), (4, TREE, json.dumps(tree(12, {"v": 1}))), (5, ARRAYS, "[" * 30 + "]" * 30), (6, ARRAYS, "[[[[" + "1" + "]]]]")]
    got = {r.id: r for r in worklist.validate(spark.createDataFrame(rows, "id int, schema string, instance string")).collect()}
    assert {i: r.valid for i, r in got.items()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}
    assert [(e.ptr, e.code) for e in got[2].errors] == [("#" + "/next" * 60 + "/v", "type")]
    assert [(e.ptr, e.schema) for e in got[4].errors] == [("#" + "/r" * 12 + "/v", "/definitions/n/optionalProperties/v/type")]
    assert [e.ptr for e in got[6].errors] == ["#/0/0/0/0"]


def test_edges(spark):
    rows = [(1, None, "1"), (2, "{}", None), (3, "{}", "{bad"), (4, "{bad", "1"), (5, '{"type":"x"}', "1"), (6, "[]", "1"), (7, "{}", "1"), (7, "{}", "1"), (None, '{"type":"string"}', "1")]
    df = spark.createDataFrame([(*r, "kept", True) for r in rows], "id int, schema string, instance string, key string, valid boolean")
    out = worklist.validate(df)
    assert out.columns == ["id", "schema", "instance", "key", "valid", "errors"]
    got = sorted(((r.id is None, r.id or 0), r.valid, r.errors and [e.code for e in r.errors]) for r in out.collect() if r.key == "kept")
    f, t = False, True
    assert got == [((f, 1), None, None), ((f, 2), None, None), ((f, 3), None, None), ((f, 4), f, ["schema"]), ((f, 5), f, ["schema"]), ((f, 6), f, ["schema"]), ((f, 7), t, []), ((f, 7), t, []), ((t, 0), f, ["type"])]
    assert worklist.validate(df.limit(0)).count() == 0


MORE = (
    ("circle", '{"definitions":{"a":{"ref":"b"},"b":{"ref":"c"},"c":{"ref":"a"}},"ref":"a"}', False), ("long chain", '{"definitions":{"a":{"ref":"b"},"b":{"ref":"c"},"c":{"ref":"d"},"d":{"type":"int8"}},"ref":"a"}', True), ("no text", "{", False), ("tag in optional", '{"discriminator":"t","mapping":{"a":{"optionalProperties":{"t":{}}}}}', False),
    ("variant of another form", '{"discriminator":"t","mapping":{"a":{"values":{}}}}', False), ("metadata holds anything", '{"metadata":{"elements":{"bad":1},"properties":3}}', True), ("property named as a keyword", '{"properties":{"elements":{"type":"string"},"definitions":{}}}', True), ("enum of numbers", '{"enum":[1]}', False),
    ("slash in a name", '{"properties":{"a/elements/b":{"type":"int8"}}}', True), ("bad below", '{"elements":{"values":{"optionalProperties":{"a":{"type":"z"}}}}}', False), ("schema as text", '{"elements":"x"}', False), ("ref in definitions", '{"definitions":{"a":{"ref":"none"}}}', False),
)


def test_rules(spark):
    df = spark.createDataFrame([*RULES, *MORE, ("null", None, False)], "rule string, schema string, ok boolean")
    for r in schemas.accepted(df).collect():
        assert (r.broken == []) == r.ok or r.rule == "null", r
        try:
            jtd.compile_schema(r.schema or "{}")
            plain = True
        except (jtd.SchemaError, json.JSONDecodeError):
            plain = False
        assert plain == r.ok or r.rule == "null"
        if r.rule == "null":
            assert r.broken is None
    said = {r.rule: r.broken for r in schemas.accepted(df.where("rule in ('unknown type', 'bad below')")).collect()}
    assert said == {"unknown type": [": unknown type: 'int64'"], "bad below": ["/elements/values/optionalProperties/a: unknown type: 'z'"]}


@pytest.mark.parametrize("nullable", [0, 1, 2])
def test_null_through_chains_of_references(spark, nullable):
    """A null fits if any reference of the chain, or its end, is nullable."""
    own = [{"nullable": True} if i == nullable else {} for i in range(3)]
    s = json.dumps({"definitions": {"a": {"ref": "b", **own[1]}, "b": {"type": "string", **own[2]}}, "properties": {"x": {"ref": "a", **own[0]}, "y": {"ref": "b"}}})
    df = spark.createDataFrame([(s, '{"x":null,"y":"s"}'), (s, '{"x":"s","y":null}')], "schema string, instance string")
    got = {r.instance: r.valid for r in worklist.validate(df).collect()}
    assert got == {'{"x":null,"y":"s"}': True, '{"x":"s","y":null}': nullable == 2}
