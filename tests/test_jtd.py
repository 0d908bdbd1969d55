import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docquarry.functions.variant import parse_tolerant
from docquarry.operators import jtd


def errors(spark, schema, texts, **kw):
    compiled = jtd.compile_schema(schema, **({"lenient": True} if kw.get("lenient") else {}))
    v = parse_tolerant(F.col("t"))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", v.alias("v"))
    return [[(e.ptr, e.code) for e in r.e] for r in df.select(jtd.errors(F.col("v"), compiled, **kw).alias("e")).collect()]


ITEM = {"properties": {"part": {"type": "uint32"}, "flag": {"enum": ["A", "N", "R"]}}}
#: A place lies in a bigger one.
PLACE = {"definitions": {"place": {"properties": {"key": {"type": "int16"}}, "optionalProperties": {"within": {"ref": "place", "nullable": True}}}}, "ref": "place"}


@pytest.mark.parametrize(
    ("schema", "text", "want"),
    [
        (ITEM, '{"part":3.0,"flag":"R"}', []), (ITEM, '{"part":-1,"flag":null}', [("#/flag", "enum"), ("#/part", "type")]), (ITEM, '{"flag":"A"}', [("#", "missing")]),
        (ITEM, '{"part":0,"flag":"N","qty":2}', [("#/qty", "additional")]), (ITEM, "[]", [("#", "properties")]), (ITEM, "null", [("#", "properties")]),
        ({"elements": {"type": "string"}}, '["a",1,null,[]]', [("#/1", "type"), ("#/2", "type"), ("#/3", "type")]), ({"elements": {}}, "{}", [("#", "elements")]),
        ({"values": {"type": "boolean"}}, '{"a":true,"b":0}', [("#/b", "type")]), ({"values": {}}, "[]", [("#", "values")]),
        ({"enum": ["x", "y"]}, '"z"', [("#", "enum")]), ({"enum": ["x", "y"]}, '"y"', []), ({"enum": ["1"]}, "1", [("#", "enum")]),
        ({"nullable": True, "elements": {"type": "int8"}}, "[1,128]", [("#/1", "type")]), ({"nullable": True, "type": "int8"}, "null", []), ({}, "[1,{}]", []),
        (PLACE, '{"key":1,"within":{"key":2,"within":null}}', []), (PLACE, '{"key":1,"within":{"key":40000}}', [("#/within/key", "type")]), (PLACE, '{"within":{"key":1}}', [("#", "missing")]),
        ({"definitions": {"bag": {"values": {"ref": "bag"}}}, "ref": "bag"}, '{"a":{},"b":{"c":{"d":[]}}}', [("#/b/c/d", "values")]),
    ],
)
def test_forms(spark, schema, text, want):
    assert errors(spark, schema, [text]) == [want]


def test_discriminator(spark):
    schema = {"elements": {"discriminator": "t", "mapping": {"a": {"properties": {"x": {"type": "uint8"}}}, "b": {"optionalProperties": {"y": {"enum": ["p"]}}}}}}
    text = '[{"t":"a","x":1},{"t":"a","x":256},{"t":"b","y":"q","w":0},{"t":"c"},{"t":1},{},3]'
    want = [("#/1/x", "type"), ("#/2/w", "additional"), ("#/2/y", "enum"), ("#/3/t", "mapping"), ("#/4/t", "discriminator"), ("#/5", "discriminator"), ("#/6", "discriminator")]
    assert errors(spark, schema, [text]) == [want]


@pytest.mark.parametrize(("name", "low", "high"), [(n, *r) for n, r in jtd.RANGES.items()])
def test_integer_ranges(spark, name, low, high):
    texts = [str(low), str(high), f"{high}.0", str(low - 1), str(high + 1), "0.5", '"0"', "null", "true"]
    assert [not e for e in errors(spark, {"type": name}, texts)] == [True] * 3 + [False] * 6


def test_timestamps(spark):
    good = ["1985-04-12T23:20:50.52Z", "1996-12-19T16:39:57-08:00", "1990-12-31T23:59:60Z", "1990-12-31T15:59:60-08:00", "1937-01-01T12:00:27.87+00:20", "2020-02-29t00:00:00z", "2024-01-01T00:00:00.123456789Z"]
    bad = ["1985-04-12", "2021-02-31T00:00:00Z", "2021-02-28T24:00:00Z", "2021-02-28T00:00:61Z", "2021-02-28 00:00:00Z", "2021-02-28T00:00:00", "x", "2021-13-01T00:00:00Z", "2021-02-28T00:00:00+00:60"]
    assert [not e for e in errors(spark, {"type": "timestamp"}, [f'"{t}"' for t in good + bad])] == [True] * len(good) + [False] * len(bad)


@pytest.mark.parametrize(
    "schema",
    [
        1, [], {"type": "x"}, {"type": 1}, {"enum": []}, {"enum": ["a", "a"]}, {"enum": [1]}, {"ref": "q"}, {"ref": 1, "definitions": {}}, {"type": "string", "enum": ["a"]}, {"discriminator": "t"}, {"mapping": {}},
        {"properties": {"a": {}}, "optionalProperties": {"a": {}}}, {"properties": 1}, {"properties": {}, "additionalProperties": 1}, {"type": "string", "foo": 1}, {"foo": 1}, {"elements": {"definitions": {}}},
        {"definitions": 1}, {"definitions": {"a": {"ref": "a"}}, "ref": "a"}, {"nullable": 1}, {"metadata": 1}, {"discriminator": 1, "mapping": {}}, {"discriminator": "t", "mapping": {"a": {"type": "string"}}},
        {"discriminator": "t", "mapping": {"a": {"properties": {"t": {}}}}}, {"discriminator": "t", "mapping": {"a": {"properties": {}, "nullable": True}}}, {"elements": {}, "additionalProperties": True}, {"elements": {}, "x": 1},
    ],
)
def test_bad_schemas(schema):
    with pytest.raises(jtd.SchemaError):
        jtd.compile_schema(schema)


def test_lenient_differs_where_stated(spark):
    assert errors(spark, {"elements": {"type": "string"}, "nullable": True}, ["[1]"], lenient=True) == [[]]
    ref = {"definitions": {"i": ITEM}, "ref": "i"}
    assert errors(spark, ref, ['{"part":1,"qty":1}'], lenient=True) == [[]]
    assert errors(spark, ref, ['{"part":1,"qty":1}']) == [[("#", "missing"), ("#/qty", "additional")]]
    assert jtd.compile_schema({"elements": {}, "x": 1}, lenient=True).form == "elements"


def test_recursion_is_bounded_loudly(spark):
    deep = '{"key":1}'
    for _ in range(8):
        deep = f'{{"key":1,"within":{deep}}}'
    with pytest.raises(PySparkException):
        errors(spark, PLACE, [deep], depth=4)


def test_absent_instance_has_null_errors(spark):
    df = spark.createDataFrame([("bad",)], "t string").select(jtd.errors(parse_tolerant(F.col("t")), jtd.compile_schema({})).alias("e"))
    assert df.first().e is None


def test_spark_types():
    s = jtd.compile_schema({"properties": {"a": {"type": "uint32"}, "b": {"elements": {"type": "timestamp"}}, "c": {"values": {"type": "int8"}}}, "optionalProperties": {"d": {"enum": ["x"]}, "e": {}}})
    assert jtd.spark_type(s).simpleString() == "struct<a:bigint,b:array<timestamp>,c:map<string,tinyint>,d:string,e:variant>"
    assert jtd.spark_type(jtd.compile_schema(PLACE)).simpleString() == "struct<key:smallint,within:variant>"


def test_messages_and_schema_paths(spark):
    schema = {"properties": {"xs": {"elements": {"type": "int8"}}}, "optionalProperties": {"t": {"discriminator": "k", "mapping": {"a": {"properties": {}}}}}}
    rows = spark.createDataFrame([('{"xs":[1,1.5,"x",999],"t":{"k":"b"}}',), ('{"t":{}}',), ('{"xs":[],"t":{"k":1}}',)], "t string").select(parse_tolerant(F.col("t")).alias("v"))
    got = rows.select(jtd.errors(F.col("v"), jtd.compile_schema(schema), verbose=True).alias("e")).collect()
    assert [[(e.ptr, e.schema, e.message) for e in r.e] for r in got] == [
        [
            ("#/t/k", "/optionalProperties/t/mapping", "discriminator value 'b' not in mapping (was: \"b\")"),
            ("#/xs/1", "/properties/xs/elements/type", "expected integer, got float (was: 1.5)"),
            ("#/xs/2", "/properties/xs/elements/type", "expected int8, got string (was: \"x\")"),
            ("#/xs/3", "/properties/xs/elements/type", "expected int8, got out of range (was: 999)"),
        ],
        [("#", "/properties/xs", "missing required property: 'xs' (was: {\"t\":{}})"), ("#/t", "/optionalProperties/t/discriminator", "discriminator 'k' must be a string (was: {})")],
        [("#/t/k", "/optionalProperties/t/discriminator", "discriminator 'k' must be a string (was: 1)")],
    ]


def test_random_schemas_accept_what_they_make_and_refuse_mutations(spark):
    rng = random.Random(5)
    import json

    def schema(d):
        form = rng.choice(["type", "enum"] + ["elements", "properties", "values"] * (d > 0))
        if form == "type":
            return {"type": rng.choice(["string", "boolean", "int8", "float64"])}
        if form == "enum":
            return {"enum": ["p", "q"]}
        if form == "properties":
            return {"properties": {k: schema(d - 1) for k in rng.sample("abc", rng.randint(1, 2))}, "optionalProperties": {"z": schema(d - 1)}}
        return {form: schema(d - 1)}

    def make(s):
        if "type" in s:
            return {"string": "x", "boolean": True, "int8": 7, "float64": 1.5}[s["type"]]
        if "enum" in s:
            return "p"
        if "elements" in s:
            return [make(s["elements"]) for _ in range(rng.randint(1, 2))]
        if "values" in s:
            return {"k": make(s["values"])}
        return {k: make(x) for k, x in s["properties"].items()} | ({"z": make(s["optionalProperties"]["z"])} if rng.random() < 0.5 else {})

    def spoil(s, x):
        if "elements" in s:
            return [spoil(s["elements"], x[0])]
        if "values" in s:
            return {"k": spoil(s["values"], x["k"])}
        if "properties" in s:
            k = next(iter(s["properties"]))
            return rng.choice([{**x, "extra": 1}, {a: b for a, b in x.items() if a != k}, {**x, k: spoil(s["properties"][k], x[k])}])
        return None

    for _ in range(8):
        s = schema(3)
        good = make(s)
        got = errors(spark, s, [json.dumps(good), json.dumps(spoil(s, good))])
        assert got[0] == []
        assert got[1] != []
