"""A training corpus from raw documents: filter, clean, deduplicate, pack.

Each stage works on all that its predecessor kept. Toxic documents go; lines
that are boilerplate of their site go; one document of each group of near
duplicates stays; passages that occur elsewhere go; what is left is packed
into training sequences. All stages but the last return the columns that they
got, under the names that they had, with ``n_chars`` (where there is one)
brought up to date.

Null texts are not toxic, have no lines and no words, are near duplicates of
each other and of all empty texts, and are packed as one end token; so are
empty texts. Rows that repeat are near duplicates, so one stays. Documents
without an id stay like others. Texts of any length are worked on whole. An
empty table gives empty tables and no pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import lines, packing, simhash, substring, toxicity
from docquarry.session import remove_folder, shared_folder, table

#: What the operators read.
READ = ("doc_id", "text", "source")


def _kept(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` over the documents with all columns but those that it reads set aside, so that none of them meets a column of its own.

    ``stage`` keeps the columns that it gets; ``n_chars`` becomes the length of the text that it gives.
    """
    aside = {f"kept_{i}": c for i, c in enumerate(docs.columns) if c not in READ}
    names = {c: a for a, c in aside.items()}
    inner = docs.toDF(*[names.get(c, c) for c in docs.columns])
    out = stage(inner)
    columns = []
    for c in docs.columns:
        kept = F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(names.get(c, c))
        columns.append(kept.alias(c))
    return out.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda d: toxicity.score(d, lexicon).where(F.col("score") < toxicity.CUTOFF_SCORE))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of a page count once, since one of them is to stay for the next stage."""
    return _kept(docs, lambda d: lines.remove_boilerplate(d, distinct=True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, simhash.deduplicate)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of passages are cut out; all else of the text, line breaks too, stays as it is."""
    return _kept(docs, lambda d: substring.remove(d, rest="rest").withColumn("text", F.when(F.col("n_removed") > 0, F.col("rest")).otherwise(F.col("text"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its token ids (little-endian unsigned 32-bit) and their checksum."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What stands between them is written to the shared folder and goes when the next stage stands."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                remove_folder(spark, before)
            before = f"{folder}/{name}"
    return docs


#: Token ids and fingerprints cannot be had in SQL; tests/llm/test_pipeline.py holds all stages against a slow version.
ORACLE_SQL = None
