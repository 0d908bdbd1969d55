"""The test that ends at the first thing wrong against the list of all errors."""

import json

import pytest
from pyspark.sql import functions as F

from docquarry.functions.variant import parse_tolerant
from docquarry.operators import jtd
from test_worklist import INSTANCES, SCHEMAS


@pytest.mark.parametrize("lenient", [False, True])
def test_valid_is_no_errors(spark, lenient):
    df = spark.createDataFrame([(x,) for x in [*INSTANCES, None, "{bad"]], "doc string").select(parse_tolerant(F.col("doc")).alias("v"))
    more = [{"elements": {"ref": "n"}, "definitions": {"n": {"properties": {"a": {"type": "int8"}}, "nullable": True}}}, {"enum": ["x"], "nullable": True}, {"type": "timestamp"}, {"properties": {"t": {}}}, {"values": {"type": "float64", "nullable": True}, "nullable": True}]
    for s in map(json.dumps, [*SCHEMAS, *more]):
        schema = jtd.compile_schema(s)
        rows = df.select(jtd.valid(F.col("v"), schema, lenient=lenient).alias("ok"), jtd.errors(F.col("v"), schema, lenient=lenient).alias("e")).collect()
        for r in rows:
            assert r.ok == (None if r.e is None else r.e == []), s
