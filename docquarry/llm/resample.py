"""Importance resampling towards a target distribution, over hashed runs of words.

A corpus is drawn from so that its hashed features come near those of a target:
each document weighs the mean log ratio of the target's share of its buckets to
the corpus's, gets a Gumbel score from that and a hash of its id, and the highest
scores are drawn.

Counting is an external sort: ``streams`` writes the buckets of all features as
packed uint16 streams, one row per block of documents with the offset of each.
``bucket_counts`` sorts block by block and run-length encodes, so that memory is
bounded by a block (or its longest document), and Spark merges the runs. When
the counts stand, ``weights`` reads the streams again: gains are gathered by
bucket and added up per document with ``np.add.reduceat``. Texts are read once.

The counts, ``buckets`` of them at most, are all that reaches the driver, besides
how many documents have each score. Scores are whole numbers in a range that the
formula bounds (about 150,000 values), and each holds few documents, since it
comes from a hash of the id; so ranks are counted within scores, and no task
sorts the whole corpus.

Null and empty texts have no features, a weight of 0 and a score. Documents without
an id hash as the empty id and come last among ties. Repeated rows are drawn one
by one; rows with the same id and score are ranked by features and weight. Very long texts are cut
into pieces at the end of a word, with the runs across the cut kept. An empty
corpus gives an empty table; an empty target leaves all gains to the smoothing.
Only the id and text columns are read, so no other name can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import remove_folder
from .common import raw_texts, slices, stored_at

BUCKETS, RUNS, SEED, PERCENT, LEAST_WORDS = 10_000, 2, 7, 25, 20
#: Bytes of text in a block of streams, and in a piece of a long text.
BLOCK, PIECE = 4 << 20, 1 << 20

#: A-Z to a-z, all that is not in a word to a space; bytes from 0x80 are in words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(folded: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes that end with a word."""
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + size)
        end = len(folded) if end < 0 else end
        yield folded[at:end]
        at = end


def features(raw: bytes, runs: int = RUNS, buckets: int = BUCKETS, piece: int = PIECE) -> tuple[np.ndarray, int]:
    """The bucket of every run of 1 to ``runs`` words, as uint16 in no certain order, and the number of words."""
    found: list[np.ndarray] = []
    before: list[bytes] = []
    n_words = 0
    for part in _pieces(raw.translate(_FOLD), piece):
        words = part.split()
        n_words += len(words)
        words = before + words
        hashes = list(map(crc32, words))
        spaced = [b" " + w for w in words]
        for n in range(1, runs + 1):
            if n > 1:
                hashes = list(map(crc32, spaced[n - 1 :], hashes))
            new = hashes[max(0, len(before) - n + 1) :]  # runs that end in words of this piece
            found.append((np.array(new, np.uint32) % buckets).astype("<u2"))
        before = words[max(0, len(words) - runs + 1) :] if runs > 1 else []
    return np.concatenate(found) if found else np.zeros(0, "<u2"), n_words


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """Blocks of documents: ids, n_words, offsets (one more than ids) and the stream of their buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket must fit 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", BLOCK):
                parts, words = zip(*[features(raw, runs, buckets) for raw in raw_texts(batch, "t")], strict=True)
                offsets = np.cumsum([0, *map(len, parts)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())), pa.array([np.concatenate(parts).tobytes()], pa.binary())],
                    names=["ids", "n_words", "offsets", "stream"],
                )

    narrow = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return narrow.mapInArrow(run, "ids array<long>, n_words array<long>, offsets array<long>, stream binary")


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and how often each comes."""
    ordered = np.sort(stream, kind="stable")  # a radix sort for 16 bits
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def bucket_counts(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                values, counts = run_lengths(np.frombuffer(packed.as_buffer(), "<u2"))
                total[values] += counts
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    merged = blocks.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[merged["bucket"].to_numpy()] = merged["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, a thousand times the log ratio of smoothed shares, rounded down."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int32)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """A thousand times a Gumbel draw from the hash of the id, rounded down."""
    h = int.from_bytes(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(blocks: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, offsets, packed in zip(*batch.columns, strict=True):
                at = offsets.values.to_numpy()
                n = np.diff(at)
                some = np.flatnonzero(n)
                weight = np.zeros(len(n), np.int64)
                if len(some):
                    gathered = gain[np.frombuffer(packed.as_buffer(), "<u2")]
                    weight[some] = np.add.reduceat(gathered, at[:-1][some], dtype=np.int64) // n[some]
                drawn = np.array([gumbel(i, seed) for i in ids.values.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(n), pa.array(weight), pa.array(weight + drawn)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return blocks.select("ids", "n_words", "offsets", "stream").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The scored documents with ``rank``: of those long enough, the highest ``percent`` in a hundred, ties to the smaller id; null for all others."""
    spark = scored.sparkSession
    fit = F.col("n_words") >= least_words
    found = scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).toArrow().sort_by([("score", "descending")])
    scores, n = found["score"].to_numpy(), found["n"].to_numpy()
    above = np.cumsum(n) - n
    draw = int(n.sum()) * percent // 100
    inside = above < draw
    if not inside.any():
        return scored.withColumn("rank", F.lit(None).cast("long"))
    cutoff = int(scores[inside][-1])
    places = spark.createDataFrame(pa.table({"score": pa.array(scores[inside], pa.int64()), "above": pa.array(above[inside], pa.int64())}))
    chosen = fit & (F.col("score") >= cutoff)
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight", "n_words")
    rank = F.col("above") + F.row_number().over(order)
    high = scored.where(chosen).join(F.broadcast(places), "score")
    high = high.select(*scored.columns, F.when(rank <= draw, rank).alias("rank"))
    return high.unionByName(scored.where(~chosen).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    runs: int = RUNS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null where it is not drawn."""
    spark = docs.sparkSession
    blocks, folder = stored_at(streams(docs, id_col, text_col, runs, buckets))
    wanted = streams(target.select(F.lit(None).cast("long").alias("i"), target_text), "i", target_text, runs, buckets)
    gain = gains(bucket_counts(blocks, buckets), bucket_counts(wanted, buckets))
    scored, _ = stored_at(weights(blocks, gain, seed))
    remove_folder(spark, folder)
    return ranked(scored, percent, least_words)
