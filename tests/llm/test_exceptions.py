"""The weights of a text against a slow matcher that tries every entry at every place, and texts full of exceptions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docquarry.llm import simhash, toxicity


def slow_matched(lexicon, folded):
    """Every entry and exception at every place, without an automaton."""
    excused = set()
    for phrase in map(toxicity.fold, lexicon.exceptions):
        for i in range(len(folded) - len(phrase) + 1):
            if folded.startswith(phrase, i):
                excused.update(range(i, i + len(phrase) - 1))
    best = {}
    for i in range(len(folded)):
        for entry, weight in lexicon.weights.items():
            if i not in excused and folded.startswith(entry, i):
                best[i] = max(best.get(i, 0.0), weight)
    return sum(best.values()), len(best)


def test_against_a_slow_matcher():
    rng = random.Random(1)
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " stup": 2.0, " stupid": 2.5, " hate ": 1.0, " bad ": 0.5}, exceptions=("stupid question", "no idiot", "idiot proof", "question of hate"))
    words = ["idiot", "stupid", "question", "hate", "bad", "no", "proof", "of", "the", "1d10t", "h4te", "stupidity"]
    for _ in range(400):
        folded = toxicity.fold(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))))
        got = toxicity.matched(lexicon.automaton(), folded)
        assert got == (pytest.approx(slow_matched(lexicon, folded)[0]), slow_matched(lexicon, folded)[1]), folded


def test_a_million_exceptions_take_linear_time():
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " stupid ": 2.0}, exceptions=("stupid question",))
    automaton = lexicon.automaton()
    took = []
    for n in (100_000, 1_000_000):
        folded = toxicity.fold("idiot word stupid question " * n)
        start = time.process_time()
        assert toxicity.matched(automaton, folded) == (3.0 * n, n)
        took.append(time.process_time() - start)
    assert took[1] < 30 * max(took[0], 0.05)


def test_the_lexicon_does_not_depend_on_partitions(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{at}/labels.parquet")
    one, other = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(13, "text"), labels.repartition(5))
    assert one.weights == other.weights
    assert one.cutoff == other.cutoff


def test_rows_that_stay_are_found_by_id_and_hash(spark, monkeypatch):
    """Rows whose hashes are equal are told apart by their ids."""
    monkeypatch.setattr(simhash, "_row", lambda i, t: F.lit(7).cast("long"))
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(20)] + [(3, " ".join(f"w3x{k}" for k in range(30)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == list(range(20))
