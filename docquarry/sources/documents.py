"""JSON documents built from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variant import parse_tolerant
from ..session import spread, table


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, doc): an order with its sorted items, as JSON text. Orders without items have none."""
    items = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"))).alias("items"))
    )
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
    joined = orders.join(items, orders.o_orderkey == items.l_orderkey, "left")
    return joined.select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.coalesce("items", F.array()).alias("items"))).alias("doc"))


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, event_type, value, doc): an event tagged by its type, with its properties below."""
    e = spread(table(spark, sf_dir, "events"))
    body = F.struct("event_type", "user_id", "value", F.from_json("props", "k long").alias("props"))
    return e.select("event_id", "event_type", "value", "props", F.to_json(body).alias("doc"))


def dirty_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, event_type, value, doc): every fifth value is text, null, missing or a list, by the id."""
    e = spread(table(spark, sf_dir, "events"))
    head = F.concat(F.lit('{"event_type":"'), F.col("event_type"), F.lit('","user_id":'), F.col("user_id").cast("string"))
    number = F.to_json(F.struct(F.col("value").alias("value")))
    number = F.substr(number, F.lit(2))
    shape = F.col("event_id") % 5
    tail = (
        F.when(shape == 0, F.concat(F.lit(',"value":"'), F.coalesce(F.col("event_id").cast("string"), F.lit("")), F.lit('"}')))
        .when(shape == 1, F.lit(',"value":null}'))
        .when(shape == 2, F.lit("}"))
        .when(shape == 3, F.lit(',"value":[1,2]}'))
        .otherwise(F.concat(F.lit(","), number))
    )
    return e.select("event_id", "event_type", "value", F.concat(head, tail).alias("doc"))


def customer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, doc): a customer with nation and region nested. The two small tables are left to the optimiser."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    c = spread(c.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    region = F.struct(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))
    nation = F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"), region.alias("region"))
    return joined.select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), nation.alias("nation"))).alias("doc"))


def parsed(df: DataFrame, text: str = "doc", out: str = "v") -> DataFrame:
    return df.withColumn(out, parse_tolerant(F.col(text)))
