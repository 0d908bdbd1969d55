"""Comparing described classes: attributes, modifiers, supertypes, methods, fields and constructors.

A description is a row: ``class_name``, boolean attributes, ``modifiers`` and
``extends`` as arrays of names, ``methods`` as a map from name to a struct of
``returns`` and ``parameters``, ``fields`` as an array of names and
``constructors`` as a number. Two collections meet in one outer join by class;
all else is column work on the joined row. A NULL part is not compared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .compare import same_set, simple_name, sorted_digest

ATTRIBUTES = ("is_interface", "is_enum", "is_record", "is_sealed")
_CHANGE = "array<struct<type:string,name:string>>"
# The marks of kinds of change in a summary.
MARKS = {
    "methodRemoved": "➖",
    "methodAdded": "➕",
    "methodChanged": "🔄",
    "inheritanceChanged": "🔗",
    "fieldsChanged": "📦",
    "constructorsChanged": "🏗️",
}
OTHER_MARK = "❓"
# The title of the changes, and what stands before and after the day in a summary's closing line.
CHANGES = "## Changes Detected\n\n"
CLOSING = ("---\n*Generated by API Tracker on ", "*\n")


def source_path(class_name: Column, packages: dict[str, str] | None = None, suffix: str = ".java") -> Column:
    """The file that a class comes from; ``packages`` maps package names to folders first."""
    for name, folder in (packages or {}).items():
        class_name = F.replace(class_name, F.lit(name), F.lit(folder))
    return F.concat(F.translate(class_name, ".", "/"), F.lit(suffix))


def same_signature(a: Column, b: Column) -> Column:
    """Equal return types, number of parameters and parameters, by simple names and in order."""
    plain = lambda xs: F.transform(xs, simple_name)
    return (simple_name(a["returns"]) == simple_name(b["returns"])) & (plain(a["parameters"]) == plain(b["parameters"]))


def _change(kind: str, name: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), (F.lit(None) if name is None else name).cast("string").alias("name"))


def _if(differs: Column, kind: str, name: Column | None = None) -> Column:
    return F.when(F.coalesce(differs, F.lit(False)), F.array(_change(kind, name))).otherwise(F.array().cast(_CHANGE))


def _methods(a: Column, b: Column) -> Column:
    """Removed, added and changed methods; none where one side does not state its methods."""
    keys = lambda m: F.map_keys(m)
    removed = F.transform(F.array_except(keys(a), keys(b)), lambda k: _change("methodRemoved", k))
    added = F.transform(F.array_except(keys(b), keys(a)), lambda k: _change("methodAdded", k))
    both = F.filter(F.array_intersect(keys(a), keys(b)), lambda k: ~F.coalesce(same_signature(a[k], b[k]), F.lit(False)))
    return F.coalesce(F.concat(removed, added, F.transform(both, lambda k: _change("methodChanged", k))), F.array().cast(_CHANGE))


def compare_classes(local: DataFrame, upstream: DataFrame, key: str = "class_name") -> DataFrame:
    """(key, status, error, changes) for each class of ``local``.

    ``upstream`` may have a column ``error`` and a column ``status``: a row
    with an error, or no row at all, makes UPSTREAM_ERROR; status
    NOT_IMPLEMENTED makes PARSE_NOT_IMPLEMENTED; else the class is MATCHING or
    DIFFERENT with the changes in the order in which they are looked for.
    """
    for name in ("error", "status"):
        if name not in upstream.columns:
            upstream = upstream.withColumn(name, F.lit(None).cast("string"))
    a = local.select(F.col(key), F.struct(*[c for c in local.columns if c != key]).alias("a"))
    b = upstream.select(F.col(key), F.struct(*[c for c in upstream.columns if c != key]).alias("b"))
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    stated = lambda c: x(c).isNotNull() & y(c).isNotNull()
    simple = lambda c: F.transform(c, simple_name)
    changes = F.concat(
        *[_if(~x(c).eqNullSafe(y(c)), "attributeChanged", F.lit(c)) for c in ATTRIBUTES],
        _if(stated("modifiers") & ~same_set(x("modifiers"), y("modifiers")), "modifiersChanged"),
        _if(stated("extends") & ~same_set(simple(x("extends")), simple(y("extends"))), "inheritanceChanged"),
        _methods(x("methods"), y("methods")),
        _if(stated("fields") & ~same_set(x("fields"), y("fields")), "fieldsChanged"),
        _if(x("constructors") != y("constructors"), "constructorsChanged"),
    )
    error = F.when(F.col("b").isNull(), "NOT_FOUND").otherwise(y("error"))
    joined = a.join(b, key, "left").withColumn("error", error).withColumn("unparsed", y("status").eqNullSafe("NOT_IMPLEMENTED"))
    usable = F.col("error").isNull() & ~F.col("unparsed")
    joined = joined.withColumn("changes", F.when(usable, changes).otherwise(F.array().cast(_CHANGE)))
    status = F.when(F.col("error").isNotNull(), "UPSTREAM_ERROR").when(F.col("unparsed"), "PARSE_NOT_IMPLEMENTED").when(F.size("changes") > 0, "DIFFERENT").otherwise("MATCHING")
    return joined.select(key, status.alias("status"), "error", "changes")


def totals(compared: DataFrame) -> DataFrame:
    """One row: total, matching, different, missing, and whether there is any difference."""
    n = lambda s: F.count_if(F.col("status") == s)
    row = compared.agg(F.count("*").alias("total"), n("MATCHING").alias("matching"), n("DIFFERENT").alias("different"), n("UPSTREAM_ERROR").alias("missing"))
    return row.withColumn("has_differences", F.col("different") > 0)


def change_lines(compared: DataFrame, key: str = "class_name") -> DataFrame:
    """One row per change of a class that differs: key, type, name and its stable ``line``."""
    each = compared.where(F.col("status") == "DIFFERENT").select(key, F.explode("changes").alias("c")).select(key, "c.type", "c.name")
    return each.withColumn("line", F.concat_ws(":", key, "type", F.when(F.col("type").startswith("method"), F.col("name")).otherwise("")))


def class_sections(compared: DataFrame, key: str = "class_name") -> DataFrame:
    """(key, section): the Markdown section of each class that differs. Classes have few changes, so a list holds them."""
    marks = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])

    def line(c: Column) -> Column:
        named = F.when(c["type"].startswith("method"), c["name"]).otherwise("unknown")
        return F.format_string("- %s **%s**: `%s`\n", F.coalesce(F.try_element_at(marks, c["type"]), F.lit(OTHER_MARK)), c["type"], named)

    text = F.concat(F.lit("### "), F.col(key), F.lit("\n\n"), F.array_join(F.transform("changes", line), ""), F.lit("\n"))
    return compared.where(F.col("status") == "DIFFERENT").select(key, text.alias("section"))


def heading_text() -> Column:
    """The table of counts that a summary begins with, from the columns of ``totals``."""
    rows = [("Total Classes", "total"), ("Matching", "matching"), ("Different", "different"), ("Missing Upstream", "missing")]
    lines = [F.concat(F.lit(f"| {name} | "), F.col(c).cast("string"), F.lit(" |\n")) for name, c in rows]
    return F.concat(F.lit("## API Comparison Summary\n\n| Metric | Count |\n|--------|-------|\n"), *lines, F.lit("\n"))


def heading(totals_row: DataFrame) -> DataFrame:
    """(text): the heading alone."""
    return totals_row.select(heading_text().alias("text"))


def summary(compared: DataFrame, made: str, key: str = "class_name") -> DataFrame:
    """(part, key, text): the whole summary in pieces that make one text in the order of part and key.

    Heading, the title of the changes where there are any, a section for each class that differs, and the closing line.
    """
    row = totals(compared)
    none = F.lit(None).cast(compared.schema[key].dataType).alias(key)
    piece = lambda n, text, df=row: df.select(F.lit(n).alias("part"), none, text.alias("text"))
    sections = class_sections(compared, key).select(F.lit(2).alias("part"), key, F.col("section").alias("text"))
    title = piece(1, F.lit(CHANGES), row.where("has_differences"))
    closing = piece(3, F.concat(F.lit(CLOSING[0]), day(F.lit(made)), F.lit(CLOSING[1])))
    return piece(0, heading_text()).unionByName(title).unionByName(sections).unionByName(closing)


def day(timestamp: Column) -> Column:
    """The date part of an ISO time, as a summary's last line has it."""
    return F.split_part(timestamp, F.lit("T"), F.lit(1))


def write_report(compared: DataFrame, folder: str, key: str = "class_name", made: str | None = None) -> str:
    """The report as files of a new version below ``folder``, which the last step makes the one that counts; its place.

    ``report`` (JSON lines), ``totals``, ``summary`` (Markdown in pieces, in order) and ``fingerprint`` are written by the tasks
    that hold their rows. Then the name of the version is written and moved to ``current`` by the
    file system: a report that fails before leaves the one before whole, and readers see all of one version.
    """
    spark = compared.sparkSession
    at = f"{folder}/version-{uuid.uuid4().hex}"
    made = made or spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    compared.write.json(f"{at}/report")
    totals(compared).withColumn("made", day(F.lit(made))).write.json(f"{at}/totals")
    pieces = summary(compared, made, key).orderBy("part", key)
    pieces.select(F.expr("left(text, length(text) - 1)")).write.text(f"{at}/summary")  # a line's end is written anyway
    sorted_digest(change_lines(compared, key), F.col("line")).write.text(f"{at}/fingerprint")
    publish(spark, folder, at)
    return at


def _file_system(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm, jvm.FileContext.getFileContext(jvm.Path(folder).getFileSystem(conf).getUri(), conf)


def publish(spark: SparkSession, folder: str, version: str) -> None:
    """Make a version the current one, in one move."""
    staged = f"{folder}/pointer-{uuid.uuid4().hex}"
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.text(staged)
    jvm, files = _file_system(spark, folder)
    found = files.util().globStatus(jvm.Path(f"{staged}/part-*"))
    overwrite = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    overwrite[0] = jvm.Options.Rename.OVERWRITE
    files.rename(found[0].getPath(), jvm.Path(f"{folder}/current.txt"), overwrite)
    files.delete(jvm.Path(staged), True)


def current_report(spark: SparkSession, folder: str) -> str | None:
    """The place of the version that counts; None before the first."""
    jvm, files = _file_system(spark, folder)
    if not files.util().exists(jvm.Path(f"{folder}/current.txt")):
        return None
    return spark.read.text(f"{folder}/current.txt").first()[0]
