"""Documents as tables of nodes: one row per value, with its pointer and that of its parent.

Children and parents then meet in an equi-join of pointers within a document,
descendants in a comparison of prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variant import MEMBERS, NODES, kind
from ..path.build import DEPTH

_ITEMS = "array<struct<ptr:string,parent:string,depth:int,v:variant>>"


def _escaped(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _below(x: Column) -> Column:
    """The children of a node of the walk."""
    item = lambda key, v: F.struct(F.concat(x["ptr"], F.lit("/"), key).alias("ptr"), x["ptr"].alias("parent"), (x["depth"] + 1).alias("depth"), v.alias("v"))
    listed = F.transform(x["v"].try_cast(NODES), lambda v, i: item(i.cast("string"), v))
    named = F.transform(F.map_entries(x["v"].try_cast(MEMBERS)), lambda e: item(_escaped(e["key"]), e["value"]))
    return F.coalesce(listed, named, F.array().cast(_ITEMS))


def node_table(df: DataFrame, value: str, *keep: str, depth: int = DEPTH) -> DataFrame:
    """(keep, ptr, parent, depth, kind, text): ``text`` is that of scalars, NULL for arrays and objects.

    Pointers are those of RFC 6901; the root's is empty and its parent NULL. A
    document deeper than ``depth`` fails the query.
    """
    root = F.array(F.struct(F.lit("").alias("ptr"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.col(value).alias("v"))).cast(_ITEMS)
    start = F.struct(F.array().cast(_ITEMS).alias("done"), root.alias("edge"))
    walk = F.aggregate(
        F.sequence(F.lit(0), F.lit(depth)),
        start,
        lambda s, _: F.struct(F.concat(s["done"], s["edge"]).alias("done"), F.flatten(F.transform(s["edge"], _below)).alias("edge")),
    )
    walked = df.where(F.col(value).isNotNull()).select(*keep, walk.alias("w"))
    whole = F.when(F.size("w.edge") == 0, F.col("w.done")).otherwise(F.raise_error(F.lit(f"document deeper than {depth} levels")).cast(_ITEMS))
    rows = walked.select(*keep, F.explode(whole).alias("x"))
    named = kind(F.col("x.v"))
    text = F.when(~named.isin("array", "object"), F.coalesce(F.col("x.v").try_cast("string"), F.lit("null")))
    return rows.select(*keep, "x.ptr", "x.parent", "x.depth", named.alias("kind"), text.alias("text"))


def descendants(nodes: DataFrame, ptr: str) -> DataFrame:
    """The rows of a node table below the node of that pointer, itself left out."""
    return nodes.where(F.col("ptr").startswith(f"{ptr}/")) if ptr else nodes.where(F.col("ptr") != "")
