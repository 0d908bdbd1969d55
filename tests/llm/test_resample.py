"""Importance resampling against a plain version that counts features in a dictionary."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from docquarry.llm import resample

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, Score double, rank int, `above` string, stream binary"


def plain_features(text, runs=2):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = WORDS.findall(lower)
    return [zlib.crc32(b" ".join(words[i : i + n])) % 10000 for n in range(1, runs + 1) for i in range(len(words) - n + 1)], len(words)


def plain(docs, target, percent=25):
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(plain_features(text)[0])
    for text in target:
        t.update(plain_features(text)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (T + 10000.0)))) for b in s}
    rows = []
    for i, text in docs:
        found, n_words = plain_features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def test_the_whole_table(spark):
    import __spark_entry__

    at = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    got = __spark_entry__.queries()["op13_resample"](spark, at).collect()
    assert sorted(map(tuple, got)) == sorted(plain(docs, target))
    assert sum(r.rank is not None for r in got) > 200


LONG = "Many different words stand here and there, again " * 6000
ROWS = [(1, LONG), (2, LONG[:500]), (3, None), (4, ""), (5, " .,!\t"), (None, LONG[:300]), (6, "É漢字 Ab9 " * 30), (6, "É漢字 Ab9 " * 30), (7, "a" * 3_000_000), (8, "x y " * 15)]


@pytest.mark.parametrize("block", [1, 1 << 22])
def test_edges(spark, monkeypatch, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    docs = spark.createDataFrame([(i, t, 0.5, 1, "a", b"s") for i, t in ROWS], SCHEMA)
    target = spark.createDataFrame([("there again",), (None,), ("",)], "text string")
    got = resample.resample(docs, target, percent=50).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain(ROWS, ["there again", None, ""], 50))
    assert resample.resample(docs.limit(0), target).count() == 0
    assert resample.resample(docs, target.limit(0)).count() == len(ROWS)
    assert resample.resample(docs, target, percent=0).where("rank is not null").count() == 0
    assert resample.resample(docs, target, percent=100).where("rank is not null").count() == 6


def test_pieces_keep_the_runs_across_their_ends():
    for text in (LONG[:3000], "a " * 500, "ab" * 700, "  x  ", "É漢字,Ab9 " * 40):
        for runs in (1, 2, 3):
            want, n = plain_features(text, runs)
            for piece in (1, 7, 100, 1 << 20):
                got, words = resample.features(text.encode(), runs, piece=piece)
                assert (sorted(got.tolist()), words) == (sorted(want), n)


def test_equal_scores_go_to_the_smaller_id(spark):
    rows = [(i, 30, 10, 5, 100 - i // 4) for i in (3, 2, 1, 0, 7, 6, 5, 4)] + [(9, 3, 1, 5, 500)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    got = {r.doc_id: r.rank for r in resample.ranked(scored, percent=75).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 5: 6, 6: None, 7: None, 9: None}


def test_run_lengths():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 10_000):
        stream = rng.integers(0, 50, n).astype("<u2")
        values, counts = resample.run_lengths(stream)
        assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == dict(collections.Counter(stream.tolist()))


def test_drawn_documents_come_nearer_to_the_target(spark):
    """What is drawn from two kinds of text is mostly of the target's kind."""
    import random

    rng = random.Random(3)
    kinds = (["red", "green", "blue", "white", "black"], ["one", "two", "three", "four", "five"])
    docs = [(i, " ".join(rng.choice(kinds[i % 5 == 0]) for _ in range(40))) for i in range(1000)]
    target = spark.createDataFrame([(" ".join(rng.choice(kinds[1]) for _ in range(500)),)], "text string")
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), target, percent=20)
    assert got.where("rank is not null and doc_id % 5 = 0").count() > 0.75 * got.where("rank is not null").count()
