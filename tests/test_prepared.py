"""Prepared collections: the same values, fewer columns and files read."""

import json

import pytest
from pyspark.sql import functions as F

from docquarry.functions.variant import as_double_or_null, parse_tolerant
from docquarry.operators import jtd
from docquarry.path import first
from docquarry.session import shared_folder
from docquarry.sources import prepared


@pytest.fixture
def docs(spark):
    rows = [(i, json.dumps({"id": i, "name": f"n{i}", "deep": {"x": i / 2, "ok": i % 2 == 0}, **({"odd": "text"} if i % 10 == 0 else {})})) for i in range(500)]
    rows += [(900, '{"id":"text","name":5}'), (901, "{bad"), (902, None)]
    return spark.createDataFrame(rows, "n int, doc string")


def test_values_and_plans(spark, docs):
    paths = prepared.measured(docs, "doc")
    assert paths == {"$['id']": "number", "$['name']": "string", "$['deep']['x']": "number", "$['deep']['ok']": "boolean"}
    p = prepared.prepare(docs, "doc", f"{shared_folder(spark)}/prepared", paths, "n", cluster="$['id']", files=8)
    want = {r.n: (r.a, r.b) for r in docs.select("n", parse_tolerant(F.col("doc")).alias("v")).select("n", as_double_or_null(first(F.col("v"), "$.id")).alias("a"), F.to_json(first(F.col("v"), "$.odd")).alias("b")).collect()}
    got = {r.n: (r.a, r.b) for r in p.rows.select("n", p.value("$['id']").alias("a"), F.to_json(p.value("$.odd")).alias("b")).collect()}
    assert got == want
    few = p.rows.where(p.value("$['id']") < 40).select(p.value("$['name']").alias("name"))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "document" not in plan
    assert f"LessThan({p.columns["$['id']"][0]},40.0)" in plan
    assert few.count() == 40
    scanned = {r.f for r in p.rows.where(p.value("$['id']") < 40).select(F.input_file_name().alias("f")).collect()}
    assert len(scanned) == 1
    assert len({r.f for r in p.rows.select(F.input_file_name().alias("f")).collect()}) > 4
    assert prepared.Prepared.read(spark, f"{shared_folder(spark)}/prepared").columns == p.columns


def test_columns_of_a_schema():
    schema = jtd.compile_schema({"properties": {"a": {"type": "uint8"}, "it's": {"enum": ["x"]}, "o": {"optionalProperties": {"t": {"type": "timestamp"}, "b": {"type": "boolean"}}}}, "optionalProperties": {"list": {"elements": {}}, "any": {}}})
    assert prepared.of_schema(schema) == {"$['a']": "number", "$['it\\'s']": "string", "$['o']['t']": "string", "$['o']['b']": "boolean"}


def test_paths_of_many_values_are_refused(spark, docs):
    with pytest.raises(ValueError, match="more than one"):
        prepared.prepare(docs, "doc", f"{shared_folder(spark)}/never", {"$..x": "number"})
