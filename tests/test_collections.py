import io
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docquarry.functions.variant import parse_tolerant
from docquarry.operators import aggregates, compare, conformance, jtd
from docquarry.path import nodes
from docquarry.sources import corpus
from docquarry.streaming import documents as streaming


def test_aggregates(spark):
    df = spark.createDataFrame([('[1,2.5,"x",null]',), ("[]",)], "t string").select(nodes(parse_tolerant(F.col("t")), "$[*]").alias("n"))
    rows = df.select(aggregates.sum_lax(F.col("n")).alias("s"), aggregates.summary(F.col("n")).alias("y"), aggregates.distinct_text(F.col("n")).alias("d")).collect()
    assert (rows[0].s, rows[1].s) == (3.5, 0.0)
    assert tuple(rows[0].y) == (2, 3.5, 1.0, 2.5, 1.75)
    assert tuple(rows[1].y) == (0, 0.0, None, None, None)
    assert rows[0].d == ['"x"', "1", "2.5", "null"]
    with pytest.raises(PySparkException):
        df.select(aggregates.mean_strict(F.col("n"))).collect()


def test_compare_items(spark):
    left = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", None, None), ("c", 3, [])], "k string, v int, s array<string>")
    right = spark.createDataFrame([("a", 1, ["y", "x", "x"]), ("b", 2, None), ("d", 4, [])], "k string, v int, s array<string>")
    got = {r.k: (r.status, r.changed) for r in compare.compare_items(left, right, ["k"], ["v", "s"], ("s",)).collect()}
    assert got == {"a": ("matching", []), "b": ("different", ["v"]), "c": ("left_only", []), "d": ("right_only", [])}
    assert {tuple(r) for r in compare.status_counts(compare.compare_items(left, right, ["k"], ["v"])).collect()} == {("matching", 1), ("different", 1), ("left_only", 1), ("right_only", 1)}


def test_digests_do_not_depend_on_order(spark):
    a = spark.createDataFrame([("g", "x"), ("g", "y"), ("g", "y")], "g string, l string")
    b = a.orderBy(F.desc("l"))
    for make in (compare.digest, compare.totals_digest):
        assert make(a, F.col("l"), "g").collect() == make(b, F.col("l"), "g").collect()
        assert make(a, F.col("l"), "g").collect() != make(a.distinct(), F.col("l"), "g").collect()


def test_conformance(spark):
    df = spark.createDataFrame([("d/y_a.json", "1"), ("y_b.json", "1 2"), ("n_a.json", "{"), ("n_b.json", "[]"), ("i_a.json", "x"), ("i_b.json", "0"), ("other", "1"), ("n_c.json", None)], "name string, text string")
    found = conformance.outcomes(df)
    assert tuple(conformance.report(found).first()) == (1, 1, 2, 1, 1, 1, 60.0)
    assert [r.name for r in conformance.failures(found).collect()] == ["n_b.json", "y_b.json"]
    assert conformance.report(found.limit(0)).first().percent is None


def test_files_zips_and_encodings(spark, tmp_path):
    text = '{"a":"é"}'
    coded = {"plain": text.encode(), "mark8": b"\xef\xbb\xbf" + text.encode(), "be16": text.encode("utf-16-be"), "le16": b"\xff\xfe" + text.encode("utf-16-le"), "be32": b"\0\0\xfe\xff" + text.encode("utf-32-be"), "le32": b"\xff\xfe\0\0" + text.encode("utf-32-le")}
    (tmp_path / "in").mkdir()
    for name, content in coded.items():
        (tmp_path / "in" / f"{name}.json").write_bytes(content)
    (tmp_path / "in" / "broken.json").write_bytes(b'"\xff"')
    (tmp_path / "in" / "note.txt").write_text("1")
    got = {r.path.rsplit("/", 1)[1].removesuffix(".json"): r.text for r in corpus.decoded(corpus.files(spark, str(tmp_path / "in"))).collect()}
    assert got == dict.fromkeys(coded, text) | {"broken": '"ÿ"'}
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("b/y_1.json", "1")
        z.writestr("skip.md", "x")
    members = corpus.zip_members(spark.createDataFrame([("z", bytearray(data.getvalue())), ("bad", bytearray(b"no"))], "path string, content binary"))
    assert sorted((r.path, r.content and bytes(r.content), r.error and r.error.split(":")[0]) for r in members.collect()) == [("bad", None, "no archive"), ("z!b/y_1.json", b"1", None)]


def test_stream_gives_the_table_result(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "events"))
    schema = jtd.compile_schema({"properties": {"k": {"type": "int8"}}})
    stream = streaming.checked(streaming.read_events(spark, str(tmp_path / "events")), "props", schema).where(F.size("errors") > 0).select("event_id")
    stream.writeStream.format("memory").queryName("checked").trigger(availableNow=True).start().awaitTermination()
    want = streaming.checked(source, "props", schema).where(F.size("errors") > 0).select("event_id")
    assert sorted(spark.table("checked").collect()) == sorted(want.collect())
