"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is a set of terms (words) with weights. For each term and each of
``samples`` sample numbers, hashes of the term give r and c, gamma variates of
shape 2, and b, uniform; with t = floor(ln w / r + b), the term's value is
ln c - r (t - b + 1), and the sample is the pair (term, t) of the least value.
Two documents agree in a sample with the probability of their generalised
Jaccard similarity, the sum of least weights over the sum of greatest.

The weight of a term is its count times the square of its length in letters,
as long words say more of a text than the short ones that every text has.

Words stay where their document is: rows are dealt by document once, and
counting words and taking least values over them need no further shuffle. The
next document is found on ids alone, ranged over the partitions, with the
partitions' first ids (as many as there are partitions) to go on from one to
the next.

Null texts are empty; texts of any length are read whole. Texts without words share a fingerprint of their own,
alike to itself and to no other. Null ids sort first; rows that repeat id and
text are one document for the order, and get the same result each. Texts of
one id are ordered by their hash. An empty table gives an empty table; only
the id and text columns are read, so no other name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SAMPLES = 32
_KEY = ["void", "id", "fp"]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, void, id, fp, text): a key without nulls that tells different documents apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("doc_id", F.col("doc_id").isNotNull().alias("void"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("fp"), "text")


def _uniform(h: Column, shift: int, bits: int) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND((1 << bits) - 1).cast("double") + 0.5) / float(1 << bits)


def _sample(term: Column, ln_w: Column, k: int) -> Column:
    """The term's value for sample k, in the high half of a long, and the sample in the low half."""
    one = F.xxhash64(term, F.lit(k))
    two = F.xxhash64(one)
    r = -F.log(_uniform(one, 0, 32) * _uniform(one, 32, 32))
    c = -F.log(_uniform(two, 0, 21) * _uniform(two, 21, 21))
    b = _uniform(two, 42, 22)
    t = F.floor(ln_w / r + b)
    value = F.log(c) - r * (t.cast("double") - b + 1)
    name = term.bitwiseXOR(t * F.lit(2654435761)).bitwiseAND(0xFFFFFFFF)
    return F.shiftleft((value * float(1 << 20)).cast("bigint"), 32).bitwiseOR(name)


def weighted_terms(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, term, ln_w): the hash of each word of a text, and the logarithm of its weight."""
    words = texts.select(*keys, F.explode(F.split(text_col, "[\\x20\\x09-\\x0D]+")).alias("word")).where("word <> ''")
    counted = words.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    return counted.select(*keys, F.xxhash64("word").alias("term"), F.log(F.col("n").cast("double") * F.pow(F.length("word").cast("double"), F.lit(2.0))).alias("ln_w"))


def signatures(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, signature array<int>) of the weighted terms (keys, term, ln_w)."""
    least = terms.groupBy(*keys).agg(*[F.min(_sample(F.col("term"), F.col("ln_w"), k)).alias(f"s{k}") for k in range(samples)])
    low = [(F.col(f"s{k}").bitwiseAND(0xFFFFFFFF) - (1 << 31)).cast("int") for k in range(samples)]
    return least.select(*keys, F.array(*low).alias("signature"))


def without_words(samples: int) -> Column:
    """The signature of texts without words."""
    return F.array_repeat(F.lit(-(1 << 31)), samples)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples that agree: an estimate of generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)).cast("double") / samples


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x.cast("bigint") + (1 << 31)), 8, "0"))), "")


def following(rows: DataFrame) -> DataFrame:
    """(void, id, fp, n_chars) with ``next`` and ``previous``: the documents in ascending order, as a ring."""
    order = ["void", "id", "fp"]
    ranged = rows.repartitionByRange(*order).withColumn("bucket", F.spark_partition_id())
    placed = cut(ranged)
    me = F.struct(*order, "n_chars")
    # the buckets are as many as partitions
    first = placed.groupBy("bucket").agg(F.min(me).alias("first"), F.max(me).alias("last"))
    ring = Window.orderBy("bucket")
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = first.select(
        "bucket",
        F.coalesce(F.lead("first").over(ring), F.first("first").over(whole)).alias("then"),
        F.coalesce(F.lag("last").over(ring), F.last("last").over(whole)).alias("before"),
    )
    within = Window.partitionBy("bucket").orderBy(*order)
    linked = placed.select("bucket", *order, "n_chars", F.lead(me).over(within).alias("ahead"), F.lag(me).over(within).alias("behind"))
    joined = linked.join(ends, "bucket")
    return joined.select(*order, "n_chars", F.coalesce("ahead", "then").alias("next"), F.coalesce("behind", "before").alias("previous"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, signature, edited_signature, near_edited, near_next.

    The edited text has the last half of its letters replaced by as many of
    the next document's first.
    """
    rows = keyed(docs, id_col, text_col)
    order = following(rows.select(*_KEY, F.length("text").cast("long").alias("n_chars")).distinct())
    placed = rows.groupBy(*_KEY).agg(F.first("text").alias("text")).join(order, _KEY)
    given = placed.select(
        F.col("previous.void").alias("void"),
        F.col("previous.id").alias("id"),
        F.col("previous.fp").alias("fp"),
        F.expr("left(text, cast(previous.n_chars div 2 as int))").alias("gift"),
    )
    edited = F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), "gift")
    both = placed.join(given, _KEY).select(*_KEY, "n_chars", "next", "text", edited.alias("edited"))
    kinds = F.array(F.struct(F.lit(False).alias("edit"), "text"), F.struct(F.lit(True).alias("edit"), F.col("edited").alias("text")))
    texts = both.select(*_KEY, F.explode(kinds).alias("kind")).select(*_KEY, "kind.edit", "kind.text")
    keys = [*_KEY, "edit"]
    signed = signatures(weighted_terms(texts, keys), keys, samples)
    pairs = signed.groupBy(*_KEY).agg(F.first(F.when(~F.col("edit"), F.col("signature")), True).alias("own"), F.first(F.when(F.col("edit"), F.col("signature")), True).alias("other"))
    nothing = without_words(samples)
    known = cut(
        both.select(*_KEY, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("next.void").alias("nv"), F.col("next.id").alias("ni"), F.col("next.fp").alias("nf"))
        .join(pairs, _KEY, "left")
        .select(*_KEY, "n_chars", "edited_sha256", "nv", "ni", "nf", F.coalesce("own", nothing).alias("signature"), F.coalesce("other", nothing).alias("edited_signature"))
    )
    after = known.select(F.col("void").alias("nv"), F.col("id").alias("ni"), F.col("fp").alias("nf"), F.col("signature").alias("next_signature"))
    full = known.join(after, ["nv", "ni", "nf"]).select(
        *_KEY,
        "n_chars",
        "edited_sha256",
        "signature",
        "edited_signature",
        likeness(F.col("signature"), F.col("edited_signature"), samples).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature"), samples).alias("near_next"),
    )
    return rows.select("doc_id", *_KEY).join(full, _KEY).drop(*_KEY)
