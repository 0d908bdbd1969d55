"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, replaces homoglyphs of other scripts by Latin letters,
drops marks that hide letters, and reads digits and signs inside words as the
letters they stand for; words that end in such signs are read both ways. The lexicon has whole words and beginnings of words,
each with the logarithm of how much likelier a toxic text is to have it. At
each place in a text the heaviest entry counts, unless an exception phrase
covers it; the sum is normalised by a power of the text's length, and the
score is 0.7 at the cutoff that separates the labels best.

Entries and cutoff are learned from labelled rows, ``max_rows`` of them at
most (a documented bound: which rows is decided by a hash of the id). Of rows
that look like copies of each other one counts, so that a copied text does not
make its words toxic. Scoring covers every whole text.

Null and empty texts have no matches and score 0; very long ones are folded
whole, in time in proportion to their length. Terms of equal gain are all taken. Labels that are null are not
used; without any toxic label nothing matches. Repeated rows score alike; an
empty table gives an empty table; columns named like an output are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import append_columns, slices, texts

MAX_ROWS = 12_000
CUTOFF_SCORE = 0.7
#: A text's sum is divided by (1 + words / LENGTH) to the power SOFTEN.
LENGTH, SOFTEN = 256, 0.5
PREFIX = range(4, 9)
SLICE = 2 << 20

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = str.maketrans("асеорхукіјѕԁԛԝһɡαοερτυνικ", "aceopxykijsdqwhgaoeptuvik")
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_LETTERS = str.maketrans(SIGNS)
#: Letters before a sign that belong to its word; no insult is longer.
LONGEST = 64
#: Harmless phrases that hold words an insult also has.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "pond scum", "stupid question", "sore loser")

_HIDDEN = re.compile("[­​-‏⁠︀-️﻿]")
_SIGN = re.compile(r"(?:(?<=[^\W_])|(?<=[@$!])|(?<!\S)(?!!))[013457@$!](?=[013457@$!]*[^\W\d_])")
#: Signs at the end of a word, that may stand for letters or for themselves.
_TAIL = re.compile(r"(?<=[^\W\d_])[013457@$]+(?![\w@$])")
_HEAD = re.compile(r"[\w@$]*$")
_GAP = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """The words of the text after folding, each between single spaces; behind them the other readings of words that end in signs."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower().translate(HOMOGLYPHS)
    else:
        text = text.lower()
    text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    plain = _GAP.sub(" ", text).strip()
    others = [_HEAD.search(text, max(0, m.start() - LONGEST), m.start())[0] + m[0].translate(_LETTERS) for m in _TAIL.finditer(text)]
    return f" {' '.join([plain, *others])} " if others else f" {plain} "


@dataclass
class Lexicon:
    """Weights of entries (a leading space: at the beginning of a word; one behind: at its end), and the cutoff."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    cutoff: float = 1.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(fold(phrase), (len(fold(phrase)), None))
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        found.make_automaton()
        return found


def matched(automaton: ahocorasick.Automaton, folded: str) -> tuple[float, int]:
    """Sum of weights, and number of places that count."""
    if not len(automaton):
        return 0.0, 0
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            excused.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if excused:
        spans = iter(_merged(excused))
        a, b = next(spans)
        kept = {}
        for s in sorted(best):
            while b <= s:
                a, b = next(spans, (len(folded), len(folded) + 1))
            if s < a:
                kept[s] = best[s]
        best = kept
    return math.fsum(best.values()), len(best)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as spans that are apart, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def normalised(total: float, folded: str) -> float:
    return total / (1 + folded.count(" ") / LENGTH) ** SOFTEN


def _terms(folded: str) -> set[str]:
    found: set[str] = set()
    for w in set(folded.split()):
        found.add(f" {w} ")
        found.update(f" {w[:n]}" for n in PREFIX if len(w) >= n)
    return found


def _likeness(folded: str) -> int:
    """A key that copies of a text mostly share: the least hash of its pairs of words."""
    w = folded.split()
    return min((zlib.crc32(f"{a} {b}".encode()) for a, b in zip(w, w[1:], strict=False)), default=zlib.crc32(folded.encode()))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of labelled rows, folds other than the held-out one, one of each look-alike."""
    fold_of = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    marked = labels.where((fold_of != 1) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    if n > max_rows:
        span = 1 << 20
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < int(span * max_rows / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(marked.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id")).drop("__id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            folded = [fold(t) for t in texts(batch, "text")]
            yield batch, [pa.array(folded, pa.string()), pa.array([_likeness(t) for t in folded], pa.int64())]

    keyed = append_columns(rows, [T.StructField("folded", T.StringType()), T.StructField("likeness", T.LongType())], make).drop("text")
    # of look-alikes the one with the least hash, whatever the partitions
    least = keyed.groupBy("likeness", "toxic").agg(F.min_by("folded", F.struct(F.xxhash64("folded"), "folded")).alias("folded"))
    return cut(least.select("folded", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Lexicon:
    """Learn a lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    What reaches the driver is bounded by the terms of ``max_rows`` texts that
    pass the test of gain, and by 256 bins.
    """
    rows = training_rows(docs, labels, max_rows)
    toxic, clean = rows.agg(F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("toxic") <= 0).cast("long")), F.lit(0))).first()
    if not toxic:
        return Lexicon()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, neg = Counter(), Counter()
            for folded, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (pos if label > 0 else neg).update(_terms(folded))
            names = list(pos | neg)
            for at in range(0, len(names), 20_000):
                part = names[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([pos[x] for x in part], pa.int64()), pa.array([neg[x] for x in part], pa.int64())], names=["term", "pos", "neg"])

    terms = rows.mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 3")
    rate = toxic / max(1, toxic + clean)
    n = F.col("pos") + F.col("neg")
    gain = F.when(F.col("pos") > 0, 2 * F.col("pos") * F.log(F.col("pos") / (n * rate))).otherwise(0.0)
    gain = gain + F.when(F.col("neg") > 0, 2 * F.col("neg") * F.log(F.col("neg") / (n * max(1e-9, 1 - rate)))).otherwise(0.0)
    weight = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.col("neg") + 0.5) / (clean + 1))
    scored = cut(terms.withColumn("gain", gain).withColumn("weight", weight))
    least = max(15.0, 2 * math.log(max(1, scored.count())))
    chosen = scored.where((F.col("gain") >= least) & (F.col("weight") >= 2.0)).select("term", "weight").collect()
    lexicon = Lexicon({r.term: float(r.weight) for r in chosen})
    lexicon.cutoff = _best_cutoff(rows, lexicon)
    return lexicon


def _best_cutoff(rows: DataFrame, lexicon: Lexicon) -> float:
    """The value with the best F1, in the middle of those as good; values are binned by logarithm."""
    spread = rows.sparkSession.sparkContext.broadcast(lexicon)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = spread.value.automaton()
        for batch in batches:
            z = [normalised(matched(automaton, t)[0], t) for t in batch.column(0).to_pylist()]
            at = [max(-99, min(156, math.floor(16 * math.log2(x)))) if x > 0 else -100 for x in z]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([y > 0 for y in batch.column(1).to_pylist()])], names=["bin", "toxic"])

    counts = rows.mapInArrow(bins, "bin int, toxic boolean").groupBy("bin").agg(F.sum(F.col("toxic").cast("long")).alias("pos"), F.count("*").alias("n")).collect()
    by_bin = {r.bin: (r.pos, r.n) for r in counts}
    total = sum(p for p, _ in by_bin.values())
    good, held, best = 0, 0, (-1.0, [])
    for b in range(156, -100, -1):
        pos, n = by_bin.get(b, (0, 0))
        good, held = good + pos, held + n
        f1 = round(2 * good / max(1, held + total), 9)
        if f1 > best[0]:
            best = (f1, [b])
        elif f1 == best[0]:
            best[1].append(b)
    return 2 ** ((max(best[1]) + min(best[1])) / 32)


def score(df: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score (0 to 1; 0.7 and more: toxic) and ``hits``, the number of places that count."""
    spread = df.sparkSession.sparkContext.broadcast(lexicon)
    half = lexicon.cutoff * (1 - CUTOFF_SCORE) / CUTOFF_SCORE

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        automaton = spread.value.automaton()
        for whole in batches:
            for batch in slices(whole, text, SLICE):
                scores, hits = [], []
                for t in texts(batch, text):
                    folded = fold(t)
                    total, n = matched(automaton, folded)
                    z = normalised(total, folded)
                    scores.append(z / (z + half))
                    hits.append(n)
                yield batch, [pa.array(scores, pa.float64()), pa.array(hits, pa.int64())]

    return append_columns(df, [T.StructField(out, T.DoubleType()), T.StructField("hits", T.LongType())], make)
