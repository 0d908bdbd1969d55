"""Mixing: targets against a plain loop, sums, limits, expectations, and the same draws for the same rows."""

import collections
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, target double, n int, leaf string, copies int"


def plain_targets(sizes, weights=(5, 2, 1), limit=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got = dict.fromkeys(order, 0.0)
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(limit * sizes[s] for s in capped)
        for s in free:
            got[s] = left * weight[s] / sum(weight[x] for x in free)
        over = [s for s in free if got[s] > limit * sizes[s]]
        if not over:
            return got
        for s in over:
            capped.add(s)
            got[s] = float(limit * sizes[s])


def check(docs, rows, slack):
    """One row for each document, sizes and targets right, words near the target, whole copies within the limit."""
    assert collections.Counter((r.doc_id, r["size"]) for r in rows) == collections.Counter((i, len(WORDS.findall(t or ""))) for i, t, _ in docs)
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t, s in docs:
        sizes[s] += len(WORDS.findall(t or ""))
    want = plain_targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        assert 0 <= r.copies <= 3
        taken[r.source] += r["size"] * r.copies
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(slack * want[s], largest[s]), s


def made(n, seed=1, sources="aaaaaabcdeé漢"):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randint(1, 5) for _ in range(int(rng.lognormvariate(3, 1)))), rng.choice(sources)) for i in range(n)]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, s, 0.5, 1, "l", 9) for i, t, s in docs], SCHEMA)


@pytest.mark.parametrize("leaf,fan", [(4096, 64), (8, 2), (1, 3)])
def test_words_come_near_their_targets(spark, leaf, fan):
    docs = made(1500)
    check(docs, mixing.mix(frame(spark, docs), leaf=leaf, fan=fan).collect(), 0.01)


def test_the_whole_table(spark):
    import __spark_entry__

    at = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    rows = __spark_entry__.queries()["op12_mixing"](spark, at).collect()
    check(docs, rows, 0.0)
    assert all(r.taken == r["size"] * r.copies for r in rows)
    taken = collections.Counter()
    for r in rows:
        taken[r.source, r.target] += r.taken
    assert all(abs(n - target) <= 0.02 * target for (_, target), n in taken.items())


def test_reruns_and_other_partitions_agree(spark):
    docs = made(800, 2)
    shuffled = random.Random(5).sample(docs, len(docs))
    runs = [sorted(map(tuple, mixing.mix(d, leaf=16, fan=4).collect())) for d in (frame(spark, docs), frame(spark, docs), frame(spark, shuffled).repartition(7), frame(spark, docs).coalesce(1))]
    assert runs[0] == runs[1] == runs[2] == runs[3]


def test_edges(spark):
    docs = [(1, None, "a"), (2, "", None), (3, " \n\t", "b"), (None, "one two", "a"), (None, "three", "a"), (4, "a b c " * 50_000, "b"), (5, "é漢\x0b字\xa0x", None), (6, "x y", ""), (6, "x y", "")]
    check(docs, mixing.mix(frame(spark, docs)).collect(), 0.0)
    assert mixing.mix(frame(spark, docs).limit(0)).count() == 0
    empty = [(1, None, "a"), (2, " ", None)]
    rows = mixing.mix(frame(spark, empty)).collect()
    assert [(r["size"], r.target, r.copies) for r in rows] == [(0, 0.0, 0)] * 2


def test_equal_rows_are_rounded_as_one(spark):
    docs = [(-7, "one two three four", "a")] * 3000 + made(300, 4, "ab")
    rows = mixing.mix(frame(spark, docs)).collect()
    check(docs, rows, 0.01)
    assert len({r.copies for r in rows if r.doc_id == -7}) <= 2


def test_one_source_is_all(spark):
    docs = [(i, t, "only") for i, t, _ in made(200, 6)]
    rows = mixing.mix(frame(spark, docs), share=0.5).collect()
    taken = sum(r["size"] * r.copies for r in rows)
    assert abs(taken - rows[0].target) <= 0.02 * rows[0].target
    assert rows[0].target == rows[0].source_size / 2


def test_many_sources_join_without_broadcast(spark, monkeypatch):
    docs = [(i, t, f"s{i % 37}") for i, t, _ in made(700, 8)]
    want = sorted(map(tuple, mixing.mix(frame(spark, docs)).collect()))
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted(map(tuple, mixing.mix(frame(spark, docs)).collect())) == want
    check(docs, mixing.mix(frame(spark, docs)).collect(), 0.0)


def test_the_mix_itself(spark):
    docs = frame(spark, [*made(300, 9), (None, "a b", "b"), (3, None, None)])
    plan = mixing.mix(docs)
    mixed = mixing.drawn(docs, plan)
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert words == plan.select(F.sum(F.col("size") * F.col("copies"))).first()[0]


def test_expectations_hold():
    """Over many draws, each document is taken as often as its fraction says."""
    rng = random.Random(7)
    sizes = [1, 2, 3, 50, 7, 7, 20]
    total = collections.Counter()
    for _ in range(20_000):
        rows = [mixing.Row(0, 0, i, n, 0, 1, 0, 0.3, rng.random()) for i, n in enumerate(sizes)]
        out = [r if r.p is None else r.settled(int(rng.random() < r.p)) for r in mixing.pivoted(iter(rows))]
        assert len(out) == len(sizes)
        for r in out:
            total[r.id] += r.copies
    assert all(abs(total[i] / 20_000 - 0.3) < 0.015 for i in range(len(sizes)))


def test_words_are_counted_in_bytes():
    texts = ["", None, "a", " a", "a ", "a b\tc\x0bd", "\x1ca", "é漢 字", "   "]
    for column in (pa.array(texts), pa.array(["x", *texts]).slice(1)):
        assert mixing.word_counts(column).tolist() == [len(WORDS.findall(t or "")) for t in texts]
