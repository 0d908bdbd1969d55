import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docquarry.functions import make, positions
from docquarry.functions.variant import parse_tolerant


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{}", None), ('{"a":[1,{"b":null}]}', None), ('{"a":1} x', (0, 8)), ("[1,\n 2,,3]", (1, 3)), ('{"a":1,\n "a":2}', (1, 1)), ('[{"a":1},{"a":2}]', None), ('{"b":{"a":1,"c":{},"a":2}}', (0, 19)),
        ("", (0, 0)), ("[NaN]", (0, 1)), ('"a', (0, 0)), ("\n\n[tru]", (2, 1)), ('{"a\\u0062":1,"ab":2}', (0, 13)),
    ],
)
def test_where_a_text_is_rejected(text, want):
    got = positions.rejection(text)
    assert (got and got[1:]) == want


def test_walk_meets_every_value_where_it_stands():
    rng = random.Random(1)

    def make_value(d):
        kind = rng.choice("sn" if d == 0 else "snao")
        if kind == "a":
            return [make_value(d - 1) for _ in range(rng.randint(0, 3))]
        if kind == "o":
            return {rng.choice(["a", "b,", 'c"', "}{"]) + str(i): make_value(d - 1) for i in range(rng.randint(0, 3))}
        return rng.choice(["x", ",:[]", '"\\', ""]) if kind == "s" else rng.choice([1, -2.5, True, None])

    for _ in range(200):
        doc = make_value(4)
        text = json.dumps(doc, indent=rng.choice([None, 1]))
        met = 0
        for path, at, is_name in positions.walk(text):
            if not is_name:
                value = doc
                for step in path:
                    value = value[step]
                assert json.JSONDecoder().raw_decode(text, at)[0] == value
                met += 1

        def count(x):
            return 1 + sum(map(count, x.values() if isinstance(x, dict) else x if isinstance(x, list) else []))

        assert met == count(doc)


def test_only_rejected_texts_are_diagnosed(spark):
    df = spark.createDataFrame([("[1]",), ("[1",), (None,), ("",)], "t string")
    got = df.select(positions.diagnose(F.col("t")).alias("d")).collect()
    assert [r.d is not None for r in got] == [False, True, False, True]
    agree = spark.createDataFrame([(t,) for t in ["1 2", "]", '{"a":1,"a":1}', "[1]]", '["', "01", "-", "1e5", ' [ "x" ] ', '{"":[]}', "nul", "[,1]", '{"a"}']], "t string")
    for r in agree.select("t", parse_tolerant(F.col("t")).isNull().alias("refused")).collect():
        assert r.refused == (positions.rejection(r.t) is not None), r.t


def test_no_text_can_close_the_array_it_is_parsed_in(spark):
    texts = ["1] ", '1,"x"]', "[1],[2]", '1,"x"] [2', "{}]", "]", ","]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(parse_tolerant(F.col("t")).isNotNull()).count() == 0


def test_making(spark):
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("a", 1), ("b", 2), ("a", 3))])
    one = spark.range(1)
    assert one.select(make.last_wins(entries).alias("m")).first().m == {"a": 3, "b": 2}
    assert one.select(make.power(F.lit(-3), F.lit(3)).alias("p"), make.power(F.lit(0), F.lit(0)).alias("q")).first() == (-27, 1)
    for base, exponent in ((10, 19), (2, -1)):
        with pytest.raises(PySparkException):
            one.select(make.power(F.lit(base), F.lit(exponent))).collect()
    numbers = spark.createDataFrame([("1.5",), ("x",), ('"1"',), ("-0e1",)], "t string")
    assert [r.n for r in numbers.select(F.to_json(make.json_number(F.col("t"))).alias("n")).collect()][1:3] == [None, None]
