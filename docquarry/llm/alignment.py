"""Alignment of two tokenizers' tokens over the bytes of each text, and how often their tokens meet.

A text is encoded by a byte-level tokenizer (A, with a space before the text) and
by a piece model (B, which adds that space). Tokens are intervals of bytes. Where a
token of each ends at the same byte, the text is cut into groups; tokens of one group
are linked. A pair of ids counts the documents of the corpus that hold it linked.

Texts are worked on in slices of about ``SLICE`` bytes, one document at least, inside
the scan's tasks, by DuckDB over Arrow tables. Neither tokenizer looks across a
single space between two other characters (for B this is read off its vocabulary; if a piece
has a space inside, texts are not cut), so a slice's different chunks are encoded and aligned
once each: token interval tables of A and B over one line of bytes; an ASOF join finds the B token that
holds the last byte of each A token, and a cut where both end there; window sums of cuts number the groups;
a range join brings the B tokens that overlap each group's interval, but where a group is one token of each. Pairs of a chunk and the chunks of a document
give the document's different pairs and their links, grouped by ids, so that no pair of occurrences is written out.

A slice keeps its documents' pairs as places in its own sorted list of pairs, and how many of its
documents hold each. Spark adds these partial counts up by pair, finds the highest count of each A id, and
brings both back to the slices, where counts are summed over links. What is shuffled is one row for each pair
of a slice, however often it comes there, so that a pair of a third of all documents is no hot key.

Null and empty texts, and those whose joined bytes of A or B differ from a space and the text, have no
tokens: zeros, and the empty text for the hash. Special tokens inside texts are plain text. Repeated rows count as
documents of their own. Very long texts are a slice of their own, so memory is bounded by a slice or the longest
text. An empty table gives an empty table. Only the id and text columns are read, so no other name can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, compress, pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import remove_folder
from .bpe import SPACE, byte_letters
from .common import slices, stored_at, texts
from .packing import BLANK, SETTLED, ByteBpe

SLICE = 4 << 20
#: Chunks that are encoded at once.
AT_ONCE = 4096

_BESIDE = re.compile(f"[{SPACE}\\x1c-\\x1f] | [{SPACE}\\x1c-\\x1f]|^ | $")
_CUT = re.compile(f"(?<=[^{SPACE}\\x1c-\\x1f]) (?=[^{SPACE}\\x1c-\\x1f])")
#: Chunks that A encodes by themselves, as Arrow's expressions have it: empty, with white space, or with letters that are not settled.
_ALONE = f"[^\0-{chr(ord(SETTLED) - 1)}]|[{BLANK}]|\\A\\z"

#: From the tables a and b of token intervals (chunk k, id, bytes s to e of one line): A's tokens with their groups
#: (``other`` is the B token of the same bytes), the rest of B's tokens with theirs, and links of id pairs by chunk.
_ALIGN = """
create or replace temp table ga as
  select k, id, s, e, other, coalesce(sum(cut) over (order by e rows between unbounded preceding and 1 preceding), 0)::bigint as g
  from (select a.k, a.id, a.s, a.e, cast(a.e = b.e as int) as cut, case when a.e = b.e and a.s = b.s then b.id end as other from a asof join b on a.e > b.s);
create or replace temp table spans as select g, min(s) as s, max(e) as e from ga where other is null group by g;
create or replace temp table gb as
  select spans.g, r.id, r.s from spans join (select id, s, e from b anti join (select s from ga where other is not null) one using (s)) r on r.s < spans.e and r.e > spans.s;
create or replace temp table links as
  with x as (select g, any_value(k) as k, id, count(*) as n from ga where other is null group by g, id), y as (select g, id, count(*) as n from gb group by g, id)
  select k, pair, sum(n)::bigint as n from (
    select k, id * $width + other as pair, 1 as n from ga where other is not null
    union all select k, x.id * $width + y.id, x.n * y.n from x join y using (g)
  ) group by all;
"""
#: From refs (document d, chunk k, in order): the different pairs of each document with their links.
_PAIRS = """
select d, pair, sum(m * n)::bigint as links
from (select d, k, count(*) as m from refs group by all) join links using (k) group by all order by d, pair
"""


def _runs(group: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, str]]:
    """The start of each run of one group, and its ids in words."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    said = list(map(str, ids.tolist()))
    for a, e in pairwise([*starts.tolist(), len(said)]):
        yield a, ",".join(said[a:e])


class Aligner:
    """Two tokenizers, with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        bpe = ByteBpe(a_path)
        self.a, self.fast, self.opens = bpe.exact, bpe.fast, bpe.opens
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {x: b for b, x in enumerate(byte_letters())}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for t, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        n = self.width = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_bytes, self.b_bytes = (pa.array(x, pa.large_binary()) for x in (self.a_bytes, self.b_bytes))
        self.a_sizes, self.b_sizes = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (self.a_bytes, self.b_bytes))
        self.db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})

    def chunks(self, text: str) -> list[str]:
        """Parts of a text, each to be encoded with a space before it."""
        if not self.cuttable:
            return [text]
        return _CUT.split(text) if _BESIDE.search(text) else text.split(" ")

    def encoded_a(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of A in each chunk, and their ids.

        Chunks of settled letters without white space go through the faster of two libraries over A's vocabulary, in one
        call: their ids part where a token opens with a space, which only the first of a chunk does.
        """
        alone = pc.match_substring_regex(pa.array(chunks, pa.string()), _ALONE).to_numpy(zero_copy_only=False)
        together = list(compress(chunks, (~alone).tolist()))
        flat = np.array(self.fast.encode_ordinary(" " + " ".join(together)) if together else [], np.int64)
        n = np.empty(len(chunks), np.int64)
        n[~alone] = np.diff(np.append(np.flatnonzero(self.opens[flat]), len(flat)))
        if not alone.any():
            return n, flat
        own = [self.fast.encode_ordinary(" " + c) if max(c, default="") < SETTLED else self.a.encode(" " + c, add_special_tokens=False).ids for c in compress(chunks, alone.tolist())]
        n[alone] = list(map(len, own))
        of_alone = np.repeat(alone, n)
        ids = np.empty(len(of_alone), np.int64)
        ids[~of_alone], ids[of_alone] = flat, np.fromiter(chain.from_iterable(own), np.int64)
        return n, ids

    def encoded_b(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of B in each chunk, and their ids."""
        found = [ids for at in range(0, len(chunks), AT_ONCE) for ids in self.b.encode(chunks[at : at + AT_ONCE], num_threads=1)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return n, np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))

    def aligned(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """By chunk: whether both give its bytes, tokens of A and of B, groups, and the groups' ids in words; the table of links stays in the database."""
        raw = [b" " + c.encode() for c in chunks]
        whole, ends = b"".join(raw), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        good, lines = np.ones(len(chunks), bool), [self.encoded_a(chunks), self.encoded_b(chunks)]
        for (n, flat), token_bytes, sizes in zip(lines, (self.a_bytes, self.b_bytes), (self.a_sizes, self.b_sizes), strict=True):
            at = np.concatenate([[0], np.cumsum(sizes[flat])])[np.concatenate([[0], np.cumsum(n)])]
            spelled = token_bytes.take(pa.array(flat)).buffers()[2].to_pybytes()[: at[-1]] if len(flat) else b""
            if spelled != whole or not np.array_equal(at[1:], ends):
                good &= np.array([spelled[s:e] == r for (s, e), r in zip(pairwise(at.tolist()), raw, strict=True)], bool)
        counts = []
        for name, (n, flat), sizes in zip(("a", "b"), lines, (self.a_sizes, self.b_sizes), strict=True):
            if not good.all():
                flat, n = flat[np.repeat(good, n)], np.where(good, n, 0)
            end = np.cumsum(sizes[flat])
            self.db.register(name, pa.table({"k": np.repeat(np.arange(len(chunks)), n), "id": flat, "s": end - sizes[flat], "e": end}))
            counts.append(n)
        for statement in _ALIGN.split(";"):
            if statement.strip():
                self.db.execute(statement, {"width": self.width} if "$width" in statement else None)
        ga, gb = (self.db.sql(f"select * from {t} order by s").to_arrow_table() for t in ("ga", "gb"))
        g = ga["g"].to_numpy()
        first = np.diff(g, prepend=-1) > 0
        each = [f"{p}|{q}" for p, q in zip(ga["id"].to_numpy().tolist(), pc.fill_null(ga["other"], -1).to_numpy().tolist(), strict=True)]
        rest = np.flatnonzero(pc.is_null(ga["other"]).to_numpy(zero_copy_only=False))
        for (start, ours), (_, theirs) in zip(_runs(g[rest], ga["id"].to_numpy()[rest]), _runs(gb["g"].to_numpy(), gb["id"].to_numpy()), strict=True):
            each[rest[start]] = f"{ours}|{theirs}"
        each = list(compress(each, first.tolist()))
        groups = np.bincount(ga["k"].to_numpy()[first], minlength=len(chunks))
        ends = np.cumsum(groups).tolist()
        return good, counts[0], counts[1], groups, [";".join(each[e - n : e]) for e, n in zip(ends, groups.tolist(), strict=True)]

    def slice(self, listed: list[str]) -> dict:
        """A slice's documents: their counts, hashes, and pairs as places in the slice's list of pairs, with links; and that list with its documents."""
        parts = [self.chunks(t) if t else [] for t in listed]
        chunks = list(dict.fromkeys(chain.from_iterable(parts)))
        number = dict(zip(chunks, range(len(chunks)), strict=True))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, int(lengths.sum()))
        good, *counts, words = self.aligned(chunks)
        doc = np.repeat(np.arange(len(parts)), lengths)
        order, ends = flat.tolist(), np.cumsum(lengths).tolist()
        whole = lengths > 0
        whole[doc[~good[flat]]] = False
        doc, flat = doc[whole[doc]], flat[whole[doc]]
        n_a, n_b, n_groups = (np.bincount(doc, c[flat], len(parts)).astype(np.int64) for c in counts)
        sha = [hashlib.sha256(";".join([words[c] for c in order[e - n : e]]).encode()).hexdigest() if w else "" for e, n, w in zip(ends, lengths.tolist(), whole.tolist(), strict=True)]
        self.db.register("refs", pa.table({"d": doc, "k": flat}))
        found = self.db.sql(_PAIRS).to_arrow_table()
        for name in ("a", "b", "refs"):
            self.db.unregister(name)
        d, pair, links = (found[c].to_numpy() for c in ("d", "pair", "links"))
        offsets = np.searchsorted(d, np.arange(len(parts) + 1))
        pairs, place, docs = np.unique(pair, return_inverse=True, return_counts=True)
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups_sha256": sha, "offsets": offsets, "places": place.astype(np.int64), "links": links.astype(np.int64), "pairs": pairs.astype(np.int64), "pair_docs": docs.astype(np.int64)}


_LOADED: dict[tuple[str, str], Aligner] = {}


def loaded(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Aligner(a_path, b_path)
    return _LOADED[a_path, b_path]


BLOCK = "slice long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, offsets array<long>, places binary, links binary, pairs array<long>, pair_docs array<long>"
_LISTS = ("n_a", "n_b", "n_groups", "groups_sha256", "offsets")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.astype("<i8").tobytes(), 3)


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), "<i8")


def blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SLICE) -> DataFrame:
    """One row for each slice of documents, aligned, with its part of the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(a_path, b_path)
        base, made = TaskContext.get().partitionId() << 32, 0

        def row(ids: list, listed: list[str]) -> pa.RecordBatch:
            x = aligner.slice(listed)
            places = np.diff(x["places"], prepend=0)
            columns = [pa.array([base + made]), pa.array([ids], pa.list_(pa.int64()))]
            columns += [pa.array([x[c]], pa.list_(pa.string() if c == "groups_sha256" else pa.int64())) for c in _LISTS]
            columns += [pa.array([_packed(places)], pa.binary()), pa.array([_packed(x["links"])], pa.binary())]
            columns += [pa.array([x[c]], pa.list_(pa.int64())) for c in ("pairs", "pair_docs")]
            return pa.RecordBatch.from_arrays(columns, names=["slice", "ids", *_LISTS, "places", "links", "pairs", "pair_docs"])

        ids: list[int | None] = []
        listed: list[str] = []
        held = 0
        for whole in batches:
            for batch in slices(whole, "t", size):
                if held and held + batch.nbytes > size:
                    yield row(ids, listed)
                    ids, listed, held, made = [], [], 0, made + 1
                ids += batch.column(0).to_pylist()
                listed += texts(batch, "t")
                held += batch.nbytes
        if ids:
            yield row(ids, listed)

    narrow = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return narrow.mapInArrow(run, BLOCK)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, a, count, best): documents that hold each pair, and whether no pair of its A id has more."""
    part = aligned.select(F.inline(F.arrays_zip("pairs", "pair_docs"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("pair_docs").alias("count"))
    a = F.expr(f"pair div {width}").alias("a")
    return part.select("pair", a, "count").withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    """A slice's documents with the counts of its pairs summed over links."""
    order = np.argsort(right["pair"].to_numpy())
    count, best = right["count"].to_numpy()[order], right["best"].to_numpy(zero_copy_only=False)[order]
    out = []
    for x in left.to_pylist():
        at, links, places = np.array(x["offsets"]), _unpacked(x["links"]), np.cumsum(_unpacked(x["places"]))
        some = np.flatnonzero(np.diff(at))

        def summed(values: np.ndarray) -> np.ndarray:
            found = np.zeros(len(at) - 1, np.int64)
            if len(some):
                found[some] = np.add.reduceat(values, at[:-1][some], dtype=np.int64)
            return found

        columns = {"doc_id": pa.array(x["ids"], pa.int64())} | {c: pa.array(x[c], pa.int64()) for c in ("n_a", "n_b", "n_groups")}
        columns |= {"n_links": summed(links), "n_best": summed(links * best[places]), "count_sum": summed(links * count[places])}
        out.append(pa.table(columns | {"groups_sha256": pa.array(x["groups_sha256"], pa.string())}))
    return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64())})


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SLICE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document. Paths are those of the tokenizer files on every executor."""
    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    aligned, folder = stored_at(blocks(docs, a_path, b_path, id_col, text_col, size))
    part = aligned.select(F.col("slice").alias("of"), F.explode("pairs").alias("pair"))
    scored = part.join(pair_counts(aligned, width), "pair").select("of", "pair", "count", "best")
    whole = aligned.drop("pairs", "pair_docs")
    out, _ = stored_at(whole.groupBy("slice").cogroup(scored.groupBy("of")).applyInArrow(_finish, RESULT))
    remove_folder(docs.sparkSession, folder)
    return out
