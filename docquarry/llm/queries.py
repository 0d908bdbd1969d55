"""The operators with production parameters on their whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import alignment, bpe, cws, html_text, lines, maxent, mixing, packing, resample, simhash, substring, topk, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, WORD_BPE).drop("text")
    out = bpe.decode(ids, WORD_BPE)
    return out.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE)
    return packing.with_crc(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    out = toxicity.score(docs, lexicon)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


OP3_SQL = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), starts as (
  select doc_id, w, unnest(range(1, len(w) - 33)) as i from words
), windows as (
  select doc_id, i, count(*) over (partition by array_to_string(w[i:i + 34], ' ')) as n from starts
), covered as (
  select distinct doc_id, i + unnest(range(0, 35)) as p from windows where n > 1
), gone as (
  select doc_id, list(p) as ps, count(*) as n from covered group by doc_id
), done as (
  select words.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
    array_to_string(case when ps is null then w else list_filter(w, lambda x, j: not list_contains(ps, j)) end, ' ') as kept
  from words left join gone on words.doc_id = gone.doc_id
)
select doc_id, n_words, n_removed, sha256(kept) as kept_sha256 from done
"""


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.remove_boilerplate(docs).select("doc_id", "source", "text", "n_lines", "n_removed")


OP5_SQL = """
with pages as (
  select source, count(*) as pages from documents group by source
), split as (
  select source, unnest(list_distinct(string_split(text, chr(10)))) as line from documents
), boilerplate as (
  select split.source, line from split join pages on split.source is not distinct from pages.source
  where trim(line, ' ' || chr(9) || chr(13)) <> ''
  group by split.source, line, pages having count(*) >= 5 and count(*) > 0.05 * pages
), hosts as (
  select source, list(line) as bad from boilerplate group by source
), done as (
  select doc_id, d.source, text, string_split(text, chr(10)) as ls,
    list_filter(string_split(text, chr(10)), lambda x: bad is null or not list_contains(bad, x)) as kept
  from documents d left join hosts on d.source is not distinct from hosts.source
)
select doc_id, source, case when text is null then null else array_to_string(kept, chr(10)) end as text,
  cast(coalesce(len(ls), 0) as bigint) as n_lines, cast(coalesce(len(ls) - len(kept), 0) as bigint) as n_removed
from done
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cws.compare(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", cws.as_text(F.col("signature")).alias("fingerprint"), cws.as_text(F.col("edited_signature")).alias("edited_fingerprint"), "near_edited", "near_next")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
with rows as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) as bigint) as score
  from rows q join rows c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from scored
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_substring": op3_substring,
    "op4_html": op4_html,
    "op5_lines": op5_lines,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_fingerprints": op8_fingerprints,
    "op9_lm": op9_lm,
    "op10_topk": op10_topk,
    "op11_alignment": op11_alignment,
    "op12_mixing": op12_mixing,
    "op13_resample": op13_resample,
}
ORACLES: dict[str, str] = {"op3_substring": OP3_SQL, "op5_lines": OP5_SQL, "op10_topk": OP10_SQL}
