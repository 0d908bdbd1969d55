"""Reports on how a parser meets the expectations of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variant import parse_tolerant

EXPECTED = {"y": "accept", "n": "reject", "i": "either"}


def outcomes(df: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """(name, expected, accepted): names begin with y_, n_ or i_; a text that could not be decoded is NULL."""
    letter = F.left(F.element_at(F.split(name, "/"), -1), F.lit(2))
    expected = F.when(letter == "y_", "accept").when(letter == "n_", "reject").when(letter == "i_", "either")
    return df.select(F.col(name).alias("name"), expected.alias("expected"), parse_tolerant(F.col(text)).isNotNull().alias("accepted")).where("expected is not null")


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(100.0 * part, whole), 1)


def report(found: DataFrame) -> DataFrame:
    """One row of counts and shares over outcomes()."""
    count = lambda e, a: F.count_if((F.col("expected") == e) & (F.col("accepted") == a))
    row = found.agg(
        count("accept", True).alias("accept_pass"), count("accept", False).alias("accept_fail"),
        count("reject", False).alias("reject_pass"), count("reject", True).alias("reject_fail"),
        count("either", True).alias("either_accept"), count("either", False).alias("either_reject"),
    )
    good, bad = F.col("accept_pass") + F.col("reject_pass"), F.col("accept_fail") + F.col("reject_fail")
    return row.withColumn("percent", percent(good, good + bad))


def failures(found: DataFrame) -> DataFrame:
    """The names that broke an expectation, in order."""
    return found.where(((F.col("expected") == "accept") & ~F.col("accepted")) | ((F.col("expected") == "reject") & F.col("accepted"))).select("name", "expected").orderBy("name")


def mismatches(cases: DataFrame, found: DataFrame, name: str = "name") -> DataFrame:
    """(name, expected, actual) where a case's ``valid`` differs from what was found; a case without a finding differs too."""
    a = cases.select(name, F.col("valid").alias("expected"))
    b = found.select(name, F.col("valid").alias("actual"))
    return a.join(b, name, "left").where(~F.col("expected").eqNullSafe(F.col("actual")))
