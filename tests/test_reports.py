"""Broken archives and bytes, digests of any size, reports that are whole or not there, and updates of windows."""

import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docquarry.operators import compare, descriptions
from docquarry.session import shared_folder
from docquarry.sources import corpus
from docquarry.streaming import documents as streams


def archive(members, method=zipfile.ZIP_DEFLATED):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", method) as z:
        for name, content in members:
            z.writestr(name, content)
    return held.getvalue()


def test_archives(spark):
    good = archive([("a.json", "[1]"), ("b/c.json", "x" * 100_000), ("d.txt", "no")])
    stored = archive([("s.json", "spoilt"), ("t.json", "{}")], zipfile.ZIP_STORED)
    rows = [("good", good), ("stored", stored.replace(b"spoilt", b"spoilT")), ("cut", good[:-20]), ("empty", b""), ("null", None), ("text", b"no archive")]
    got = {r.path: r for r in corpus.zip_members(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert set(got) == {"good!a.json", "good!b/c.json", "stored!s.json", "stored!t.json", "cut", "empty", "null", "text"}
    assert bytes(got["good!b/c.json"].content) == b"x" * 100_000
    assert bytes(got["stored!t.json"].content) == b"{}"
    assert all(got[p].content is None and got[p].error.startswith("no archive") for p in ("cut", "empty", "null", "text"))
    assert got["stored!s.json"].error.startswith("broken member")
    assert got["good!a.json"].error is None


def test_one_archive_is_unpacked_in_many_tasks(spark):
    one = spark.createDataFrame([("z", archive([(f"{i}.json", f"[{i}]") for i in range(400)]))], "path string, content binary")
    members = corpus.zip_members(one)
    tasks = members.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) > 1
    assert sum(r["count"] for r in tasks) == 400


def test_broken_bytes_stand_for_their_own_characters():
    for raw, text in ((b"\xff", "ÿ"), (b"a\xffb\xe9", "aÿbé"), (b"\xc3", "Ã"), (b"\xe2\x82", "â\x82"), (b"\xc0\xaf\xff", "/ÿ"), (b"\xf5\x80\x80\x80!", "õ\x80\x80\x80!"), ("é漢".encode() + b"\x80", "é漢\x80")):
        assert raw.decode("utf-8", "docquarry.own") == text
    assert corpus.decode_robustly(b'{"a":"\xff"}') == '{"a":"ÿ"}'


@pytest.mark.parametrize("n", [0, 1, 50, 400, 3000])
def test_digest_of_any_size(spark, n):
    rng = random.Random(n)
    lines = [f"line {rng.randint(0, n)}" for _ in range(n)] + ["often"] * (n // 2)
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {compare.sorted_digest(d, F.col("line"), length=16, leaf=100).first().digest for d in (df.coalesce(1), df.repartition(50), df.orderBy("line"), df.orderBy(F.rand(3)))}
    assert len(got) == 1
    if n <= 50:
        plain = hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()[:16] if lines else "0" * 16
        assert got == {plain}
    else:
        other = spark.createDataFrame([(x,) for x in [*lines[:-1], "changed"]], "line string")
        fewer = spark.createDataFrame([(x,) for x in lines[:-1]], "line string")
        assert len(got | {compare.sorted_digest(d, F.col("line"), length=16, leaf=100).first().digest for d in (other, fewer)}) == 3


def test_report_is_whole_or_the_one_before(spark):
    changes = "class_name string, status string, error string, changes array<struct<type:string,name:string>>"
    one = spark.createDataFrame([("b.B", "DIFFERENT", None, [("methodAdded", "x")]), ("a.A", "MATCHING", None, []), ("a.C", "DIFFERENT", None, [("other", None)])], changes)
    folder = f"{shared_folder(spark)}/reports"
    assert descriptions.current_report(spark, folder) is None
    first = descriptions.write_report(one, folder, made="2024-01-02T03:04:05")
    assert descriptions.current_report(spark, folder) == first
    pieces = sorted((r.file, r.value) for r in spark.read.text(f"{first}/summary", wholetext=True).select("value", F.input_file_name().alias("file")).collect())
    assert "".join(v for _, v in pieces) == (
        "## API Comparison Summary\n\n| Metric | Count |\n|--------|-------|\n| Total Classes | 3 |\n| Matching | 1 |\n| Different | 2 |\n| Missing Upstream | 0 |\n\n"
        "## Changes Detected\n\n### a.C\n\n- ❓ **other**: `unknown`\n\n### b.B\n\n- ➕ **methodAdded**: `x`\n\n---\n*Generated by API Tracker on 2024-01-02*\n"
    )
    failing = one.withColumn("error", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        descriptions.write_report(failing, folder, made="2024-01-02T03:04:05")
    assert descriptions.current_report(spark, folder) == first
    second = descriptions.write_report(one.where("status = 'MATCHING'"), folder, made="2024-01-02T03:04:05")
    assert descriptions.current_report(spark, folder) == second != first
    assert "Changes Detected" not in "".join(r.value for r in spark.read.text(f"{second}/summary").collect())


def test_windows_are_updated_batch_by_batch(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows, state, source = (f"{tmp_path}/{x}" for x in ("rows", "state", "in"))
    events = lambda *es: spark.sql("select * from values " + ",".join(f"({i}L, timestamp '2024-01-01 {t}', 1L, 'view', {v}D, '')" for i, t, v in es) + " t(event_id, ts, user_id, event_type, value, props)")
    for batch in (events((1, "10:05:00", 1.0), (2, "10:15:00", 2.0), (3, "11:00:00", 4.0)), events((4, "10:59:00", 8.0), (5, "12:30:00", 16.0)), events((6, "10:30:00", 99.0), (7, "12:31:00", 32.0))):
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_events(spark, source, schema=schema).withColumn("doc", F.to_json(F.struct("value")))
        streams.run_to_table(streams.windowed_sums(stream, "ts", "doc", "$.value"), rows, state)
    got = {r.start.hour: (r.n, r.total) for r in streams.latest(spark, rows, "start").collect()}
    assert got == {10: (3, 11.0), 11: (1, 4.0), 12: (2, 48.0)}  # event 6 comes after the watermark
    numbers = [r.batch for r in spark.read.option("basePath", rows).parquet(rows).select("batch").distinct().collect()]
    assert len(numbers) >= 3
