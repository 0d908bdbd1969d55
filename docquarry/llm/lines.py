"""Removal of boilerplate lines by their frequency within a site, in DataFrame operations only.

A line of a page is boilerplate if more than ``ratio`` of its host's pages,
and at least ``min_pages`` of them, have it. As each page has a bounded number
of lines on average, a host has at most that average divided by ``ratio`` such
lines: they are collected per host, and pages meet them in one join. Where all
of them fit ``broadcast_bytes``, measured first, the join is a broadcast;
otherwise pages are salted, so that a host with a third of all pages is spread
over ``salts`` times as many keys.

With ``distinct`` pages of one host with the same text (told by its 64-bit
hash) count as one, among the pages with a line and among all, so that a
document does not become boilerplate by being copied; otherwise each counts.

Texts of any length are split whole. Lines are what stands between newlines; lines of white space alone are never
boilerplate. Null texts have no lines and stay null. Null hosts make one host
of their own. Repeated rows are pages of their own, but with ``distinct``. An empty table gives an
empty table. Columns keep their names; ``n_lines`` and ``n_removed`` replace
columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import fresh

RATIO = 0.05
MIN_PAGES = 5
#: Pages of a host that meet its lines in one task, where the lines are too many to broadcast.
PAGES = 1 << 17
BROADCAST_BYTES = 16 << 20


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """(host, lines, pages): each host's boilerplate lines and how many pages it has, for hosts that have such lines."""
    page = [F.xxhash64(F.col(text_col)).alias("page")] if distinct else []
    every = docs.select(F.col(host_col).alias("host"), *page)
    found = docs.select(F.col(host_col).alias("host"), *page, F.explode(F.array_distinct(F.split(text_col, "\n"))).alias("line")).where(F.trim("line", F.lit(" \t\r")) != "")
    if distinct:
        every, found = every.distinct(), found.distinct()
    pages = every.groupBy("host").agg(F.count("*").alias("pages"))
    lines = (
        found.groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_pages)
    )
    many = lines.join(pages, lines.host.eqNullSafe(pages.host)).where(F.col("n") > ratio * F.col("pages"))
    return many.groupBy(lines.host).agg(F.collect_list("line").alias("lines"), F.max("pages").alias("pages"))


def remove_boilerplate(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    pages: int = PAGES,
    broadcast_bytes: int = BROADCAST_BYTES,
    distinct: bool = False,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and ``n_lines`` and ``n_removed`` added.

    Where the lines are too many to broadcast they meet the pages by host; a
    host of more than ``pages`` pages is dealt over as many tasks as it fills.
    Such hosts are one to ``pages`` pages at most, which bounds their list.
    """
    found = cut(boilerplate(docs, host_col, text_col, ratio, min_pages, distinct))
    size = found.agg(F.sum(F.expr("aggregate(lines, 64L, (s, x) -> s + octet_length(x) + 16)"))).first()[0] or 0
    host, bad, of, salt, left, deals, big = fresh(docs, "host", "bad", "of", "salt", "left", "deals", "big")
    named = found.select(F.col("host").alias(host), F.col("lines").alias(bad))
    if size <= broadcast_bytes:
        joined = docs.join(F.broadcast(named), docs[host_col].eqNullSafe(named[host]), "left")
    else:
        dealt = found.select(F.col("host").alias(host), F.col("lines").alias(bad), F.ceil(F.col("pages") / pages).cast("int").alias(deals))
        heavy = dealt.where(F.col(deals) > 1).select(F.col(host).alias(big), deals)
        spread = docs.join(F.broadcast(heavy), docs[host_col].eqNullSafe(heavy[big]), "left")
        spread = spread.withColumn(salt, F.when(F.col(deals).isNull(), 0).otherwise(F.pmod(F.xxhash64(text_col), F.col(deals)).cast("int"))).drop(big, deals)
        salted = dealt.withColumn(of, F.explode(F.sequence(F.lit(0), F.col(deals) - 1))).drop(deals)
        joined = spread.join(salted, spread[host_col].eqNullSafe(salted[host]) & (spread[salt] == salted[of]), "left")
    split = F.split(text_col, "\n")
    kept = F.filter(split, lambda x: ~F.array_contains(bad, x))
    marked = joined.withColumn(left, F.when(F.col(bad).isNull(), split).otherwise(kept))
    text = F.when(F.size(left) == F.size(split), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    new = {"n_lines": F.size(split), "n_removed": F.size(split) - F.size(left)}
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    none = F.col(text_col).isNull()
    return marked.select(*columns, *[F.when(none, F.lit(0)).otherwise(v).cast("long").alias(k) for k, v in new.items()])
