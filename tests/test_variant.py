import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docquarry.functions import variant as V


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.parse_tolerant(F.col("t")).alias("v"))


GOOD = ["1", "-0", "1.5e3", '"a\\u00e9\\n"', "null", "true", "[]", "{}", ' {"a" : [1, {"b":null}]} ', '"\U0001f600"']
BAD = ["", " ", "{} {}", "1 2", "1,2", "1],[2", "1}", "1}{", "01", "1.", ".5", "+1", "{'a':1}", '{"a":1,"a":2}', "[1,]", '{"a":1,}', "tru", "NaN", "Infinity", '"a', '"\t"', "[1", "]", "﻿1", "1e5-3", '{"a" 1}', "// c\n1"]


def test_tolerant_parse_accepts_documents_only(spark):
    assert [r.ok for r in frame(spark, GOOD).select(F.col("v").isNotNull().alias("ok")).collect()] == [True] * len(GOOD)
    assert [r.t for r in frame(spark, [*BAD, None]).where("v is not null").collect()] == []


def test_strict_parse_raises(spark):
    assert frame(spark, ["1"]).select(V.as_long(V.parse_strict(F.col("t")))).first()[0] == 1
    for bad in ("{} {}", None):
        with pytest.raises(PySparkException):
            frame(spark, [bad]).select(F.to_json(V.parse_strict(F.col("t")))).collect()


def test_kinds(spark):
    texts = ["null", "true", "1", "1.5", "1e300", '"x"', "[1]", '{"a":1}', "bad"]
    assert [r[0] for r in frame(spark, texts).select(V.kind(F.col("v"))).collect()] == ["null", "boolean", "number", "number", "number", "string", "array", "object", None]


@pytest.mark.parametrize(
    ("text", "double", "long", "string", "boolean"),
    [
        ("1", 1.0, 1, None, None), ("1.0", 1.0, 1, None, None), ("1.23e2", 123.0, 123, None, None), ("120.0e-1", 12.0, 12, None, None), ("1.5", 1.5, None, None, None),
        ("9223372036854775807", 9.223372036854775807e18, 9223372036854775807, None, None), ("9223372036854775808", 9.223372036854775808e18, None, None, None),
        ("-9223372036854775808", -9.223372036854775808e18, -9223372036854775808, None, None), ("1e-20", 1e-20, None, None, None), ("1e400", None, None, None, None), ("1e30", 1e30, None, None, None),
        ('"12"', None, None, "12", None), ("true", None, None, None, True), ("null", None, None, None, None), ("[1]", None, None, None, None), ('{"a":1}', None, None, None, None),
    ],
)
def test_conversions(spark, text, double, long, string, boolean):
    v = F.col("v")
    lax = [V.as_double_or_null(v), V.as_long_or_null(v), V.as_string_or_null(v), V.as_boolean_or_null(v)]
    want = (double, long, string, boolean)
    assert tuple(frame(spark, [text]).select(*lax).first()) == want
    for strict, x in zip((V.as_double, V.as_long, V.as_string, V.as_boolean), want, strict=True):
        if x is None:
            with pytest.raises(PySparkException):
                frame(spark, [text]).select(strict(v)).collect()
        else:
            assert frame(spark, [text]).select(strict(v)).first()[0] == x


def test_equality_is_structural(spark):
    pairs = [('{"a":1,"b":[2]}', '{"b":[2],"a":1.0}', True), ("[1,2]", "[2,1]", False), ("null", "null", True), ("1", '"1"', False), ("bad", "bad", True), ("bad", "null", False)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    a, b = (V.parse_tolerant(F.col(c)) for c in "ab")
    assert [r[0] for r in df.select(V.same(a, b)).collect()] == [p[2] for p in pairs]


def test_navigation(spark):
    df = frame(spark, ['{"a":[10,20,null],"n":null}'])
    v = F.col("v")
    a = V.member(v, "a")
    row = df.select(
        V.as_long(V.element(a, 0)), V.as_long(V.element(a, -2)), V.element(a, 9).isNull(), V.missing(V.element(a, 2)), V.member(v, "n").isNull(), V.value_or_null(V.member(v, "n")).isNull(),
        F.size(V.children(v)), F.size(V.children(a)), F.size(V.children(V.element(a, 0))), F.size(V.as_members(v)), F.size(V.as_elements(a)),
    ).first()
    assert tuple(row) == (10, 20, True, True, False, True, 2, 3, 0, 2, 3)


def test_escaping(spark):
    texts = ['a"b\\c', "line\nend\t", "é\u0001", ""]
    assert [json.loads(r[0]) for r in frame(spark, texts).select(V.escaped(F.col("t"))).collect()] == texts
