"""Comparing two collections of described items, and digests of them.

Items are compared by key in one full outer join; attributes are compared
null-safely; lists of names as sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets; NULL is the empty one."""
    clean = lambda x: F.array_sort(F.array_distinct(F.coalesce(x, F.array().cast("array<string>"))))
    return clean(a) == clean(b)


def simple_name(name: Column) -> Column:
    """The last part of a dotted name, without type parameters."""
    return F.substring_index(F.regexp_replace(name, r"<.*>", ""), ".", -1)


def compare_items(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], sets: tuple[str, ...] = ()) -> DataFrame:
    """(keys, status, changed): status is left_only, right_only, different or matching.

    ``changed`` lists the columns of ``values`` that differ, in order; those in
    ``sets`` are arrays of names whose order does not matter.
    """
    a = left.select(*keys, F.struct(*values).alias("a"))
    b = right.select(*keys, F.struct(*values).alias("b"))
    differ = [F.when(~(same_set(F.col(f"a.{v}"), F.col(f"b.{v}")) if v in sets else F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))), F.lit(v)) for v in values]
    both = a.join(b, keys, "full_outer")
    changed = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.array_compact(F.array(*differ))).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").when(F.size("changed") > 0, "different").otherwise("matching")
    return both.withColumn("changed", changed).select(*keys, status.alias("status"), "changed")


def status_counts(compared: DataFrame, *by: str) -> DataFrame:
    return compared.groupBy(*by, "status").agg(F.count("*").alias("n"))


def digest(df: DataFrame, line: Column, *by: str, length: int = 7) -> DataFrame:
    """Per group a short SHA-256 over its sorted lines; zeros for a group without any.

    The lines of one group meet in one row: meant for groups of bounded size,
    such as the members of one described item.
    """
    lines = F.array_sort(F.collect_list(line))
    return df.groupBy(*by).agg(F.when(F.size(lines) > 0, F.left(F.sha2(F.array_join(lines, "\n"), 256), F.lit(length))).otherwise("0" * length).alias("digest"))


#: Different lines that one row of a digest's tree holds about at most.
LEAF = 4096


def sorted_digest(df: DataFrame, line: Column, length: int = 7, leaf: int = LEAF) -> DataFrame:
    """One row (digest) for lines in any number and order, the same under any partitioning.

    Up to ``leaf`` lines it is what ``digest`` gives: the hash of the sorted lines. Beyond,
    it is the root of a tree whose boundaries are fixed by the lines alone: different lines with their
    counts go to leaves by the first digits of their own hashes, as many digits as make
    leaves of ``leaf`` lines, a leaf hashes its sorted lines, and sixteen hashes make one on each level up.
    Equal lines are counted before they are dealt, so no leaf grows with copies.
    """
    counted = df.select(line.alias("line")).where("line is not null").groupBy("line").agg(F.count("*").alias("n"))
    different, lines = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if lines <= leaf:
        return digest(df.select(line.alias("line")), F.col("line"), length=length)
    digits = 0
    while different > leaf * 16**digits:
        digits += 1
    h = F.sha2("line", 256)
    level = counted.select(F.left(h, F.lit(digits)).alias("at"), F.concat(h, F.lit(":"), F.col("n").cast("string")).alias("said"))
    for d in range(digits, -1, -1):
        level = level.groupBy(F.left("at", F.lit(d)).alias("at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("said")), "\n"), 256).alias("own"))
        level = level.select("at", F.concat("at", F.lit("="), "own").alias("said"), "own")
    return level.select(F.left("own", F.lit(length)).alias("digest"))


def totals_digest(df: DataFrame, line: Column, *by: str) -> DataFrame:
    """Per group a digest that does not depend on order and needs no list: for groups of any size."""
    h = F.xxhash64(line)
    return df.groupBy(*by).agg(F.count(line).alias("n"), F.bit_xor(h).alias("mixed"), F.sum(F.shiftright(h, 20)).alias("added"))
