"""Prepared collections: documents parsed once, with the values of chosen paths beside them as columns.

A query over JSON text parses every document again. Here documents are written once, as a
VARIANT and as a plain column for each chosen path, and clustered by one of
the paths, so that a query of those paths reads a few columns and no document, and a
filter on the clustering path skips the files and row groups whose range does not meet it.

Paths are chosen by hand, from a schema (``of_schema``: what it says is a scalar), or by measure (``measured``: what
most documents have, of one kind). A value of another kind than its column's leaves
the column NULL, and is read from the document: ``value`` gives what
``path.first`` would, in the column's type. The columns are named in the table's properties file,
so ``Prepared.read`` needs the folder alone.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variant import as_boolean_or_null, as_double_or_null, as_string_or_null, parse_tolerant
from ..operators import jtd
from ..operators.structure import node_rows
from ..path import first, single

#: Columns that are chosen by measure at most.
MOST = 200
_CONVERT = {"number": as_double_or_null, "string": as_string_or_null, "boolean": as_boolean_or_null}


def of_schema(schema: jtd.Schema, prefix: str = "$") -> dict[str, str]:
    """The kinds of the scalar members that a schema names, by path; references and tags are left to the document."""
    if schema.form == "enum" or (schema.form == "type" and schema.name in ("string", "timestamp")):
        return {prefix: "string"}
    if schema.form == "type":
        return {prefix: "boolean" if schema.name == "boolean" else "number"}
    out: dict[str, str] = {}
    if schema.form == "properties":
        for name, below in {**schema.required, **schema.optional}.items():
            quoted = name.replace("\\", "\\\\").replace("'", "\\'")
            out |= of_schema(below, f"{prefix}['{quoted}']")
    return out


def measured(docs: DataFrame, text: str, share: float = 0.5, deepest: int = 3, most: int = MOST) -> dict[str, str]:
    """The kinds of the scalar members that at least ``share`` of the documents have in one kind, by path, the commonest first."""
    named = docs.select(F.monotonically_increasing_id().alias("_doc"), F.col(text).alias("_text"))
    nodes = node_rows(named, "_text", "_doc", ptr=True)
    n = nodes.where("depth = 0").count()
    plain = nodes.where((F.col("depth") >= 1) & (F.col("depth") <= deepest) & F.col("kind").isin(*_CONVERT) & F.col("name").isNotNull() & ~F.col("ptr").rlike(r"[~'\\]|/[0-9]+(/|\z)"))
    found = plain.groupBy("ptr", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= share * n)
    rows = found.orderBy(F.col("n").desc(), "ptr").limit(most).collect()
    best: dict[str, str] = {}
    for r in rows:
        best.setdefault("$" + "".join(f"['{x}']" for x in r.ptr.split("/")[1:]), r.kind)
    return best


@dataclass
class Prepared:
    """A prepared collection, as its folder holds it."""

    rows: DataFrame
    columns: dict[str, tuple[str, str]]  # path to name of the column and kind

    def value(self, path: str) -> Column:
        """The first match of a path: from its column if it has one, else from the document."""
        if path not in self.columns:
            return first(F.col("document"), path)
        return F.col(self.columns[path][0])

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Prepared:
        said = json.loads(spark.read.text(f"{folder}/columns", wholetext=True).first()[0])
        return Prepared(spark.read.parquet(f"{folder}/rows"), {p: (c, k) for p, (c, k) in said.items()})


def prepare(docs: DataFrame, text: str, folder: str, paths: dict[str, str], *keep: str, cluster: str | None = None, files: int | None = None) -> Prepared:
    """Write the documents of a column with columns for ``paths`` (path to number, string or boolean), clustered by one of them.

    Clustering deals ranges of the path's values to ``files`` files, so equal values of a hot range may share a
    large file, which is split for reading. Texts that are no documents have NULL for a document.
    """
    for p in paths:
        if not single(p):
            raise ValueError(f"{p} may match more than one value")
    spark = docs.sparkSession
    columns = {p: (f"p{i}", k) for i, (p, k) in enumerate(paths.items())}
    parsed = docs.select(*keep, parse_tolerant(F.col(text)).alias("document"))
    wide = parsed.select(*keep, *[_CONVERT[k](first(F.col("document"), p)).alias(c) for p, (c, k) in columns.items()], "document")
    if cluster:
        by = columns[cluster][0]
        wide = (wide.repartitionByRange(files, by) if files else wide.repartitionByRange(by)).sortWithinPartitions(by)
    wide.write.parquet(f"{folder}/rows")
    spark.createDataFrame([(json.dumps(columns),)], "said string").coalesce(1).write.text(f"{folder}/columns")
    return Prepared.read(spark, folder)
