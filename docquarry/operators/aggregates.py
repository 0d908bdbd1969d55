"""Aggregates over matches: within a document as columns, over documents after explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variant import as_double, as_double_or_null, bound, kind
from ..path import nodes


def matches(df: DataFrame, value: str, path: str, *keep: str) -> DataFrame:
    """One row per match: the columns of ``keep``, its place ``pos`` from 0, and ``match``."""
    return df.select(*keep, F.posexplode(nodes(F.col(value), path)).alias("pos", "match"))


def sum_lax(found: Column) -> Column:
    """The sum of a list's numbers; others are passed over. 0 for none."""
    return F.aggregate(found, F.lit(0.0), lambda s, x: s + F.coalesce(as_double_or_null(x), F.lit(0.0)))


def mean_strict(found: Column) -> Column:
    """The mean of a list of numbers; anything else in it fails the query. NULL for none."""
    return bound(found, lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda s, x: s + as_double(x)) / F.size(xs)))


def summary(found: Column) -> Column:
    """count, sum, min, max and mean of a list's numbers."""
    numbers = F.array_compact(F.transform(found, as_double_or_null))

    def figures(xs: Column) -> Column:
        total, n = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs)
        return F.struct(n.cast("long").alias("n"), total.alias("total"), F.array_min(xs).alias("least"), F.array_max(xs).alias("most"), F.when(n > 0, total / n).alias("mean"))

    return bound(numbers, figures)


def last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def distinct_text(found: Column) -> Column:
    """The different values of a list, as canonical text in order."""
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.to_json(x))))


def kind_counts(df: DataFrame, match: str = "match") -> DataFrame:
    return df.groupBy(kind(F.col(match)).alias("kind")).agg(F.count("*").alias("n"))


def top(matched: DataFrame, by: Column, k: int, *ties: str) -> DataFrame:
    """The k rows with the greatest values of ``by``; ``ties`` decide among equals. NULLs come last."""
    return matched.orderBy(by.desc_nulls_last(), *ties).limit(k)
