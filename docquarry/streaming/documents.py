"""The same columns on a stream: paths and validation keep no state, counts per window do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.variant import as_double_or_null, parse_tolerant
from ..operators import jtd
from ..path import first


def read_events(spark: SparkSession, folder: str, pattern: str = "*.parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """A stream of the Parquet files in a folder, in the schema of the events table."""
    schema = schema or "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def checked(events: DataFrame, text: str, schema: jtd.Schema) -> DataFrame:
    """Add ``v`` and ``errors`` (of the JSON text), on a stream or a table."""
    with_value = events.withColumn("v", parse_tolerant(F.col(text)))
    return with_value.withColumn("errors", jtd.errors(F.col("v"), schema))


def windowed_sums(events: DataFrame, time: str, text: str, path: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, n, total) per tumbling window of a number in the documents; a window that ends more than ``late`` before the latest time seen takes no more rows."""
    marked = events.withWatermark(time, late).withColumn("x", as_double_or_null(first(parse_tolerant(F.col(text)), path)))
    return marked.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.sum("x").alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def run_to_table(stream: DataFrame, rows: str, state: str) -> None:
    """Run until all that is there now has been read; each batch's changed rows are in Parquet below ``rows``, progress and state at ``state``.

    Rows are updates: a window comes again when it has changed, and its state goes when
    the watermark has passed it. A batch writes to a folder of its own, so a batch that
    is run again after a loss changes nothing; ``latest`` reads what counts.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, rows: str, *keys: str) -> DataFrame:
    """The last update of each key."""
    found = spark.read.option("basePath", rows).parquet(rows)
    others = [c for c in found.columns if c not in (*keys, "batch")]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(*keys, "x.*")
