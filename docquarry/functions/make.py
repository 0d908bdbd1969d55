"""Building JSON values from columns, and writing them as text."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .variant import bound, is_kind, parse_tolerant


def json_object(**members: Column) -> Column:
    """An object of the given members; NULL columns become JSON null."""
    return F.to_variant_object(F.struct(*[c.alias(k) for k, c in members.items()]))


def json_array(*elements: Column) -> Column:
    """An array of values of one type."""
    return F.to_variant_object(F.array(*elements))


def json_map(members: Column) -> Column:
    """An object from a map of names to values of one type, or to variants."""
    return F.to_variant_object(members)


def json_number(text: Column) -> Column:
    """A number as JSON spells it; NULL for any other text."""
    v = parse_tolerant(text)
    return bound(v, lambda x: F.when(is_kind(x, "number"), x))


def last_wins(entries: Column) -> Column:
    """A map from an array of (key, value) structs; of entries with one key the last counts."""

    def chosen(es: Column) -> Column:
        order = F.array_sort(F.transform(es, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"))))
        lasts = bound(order, lambda o: F.filter(o, lambda x, i: ~F.coalesce(F.get(o, i + 1)["key"] == x["key"], F.lit(False))))
        return F.map_from_entries(F.transform(lasts, lambda x: F.get(es, x["i"])))

    return bound(entries, chosen)


def common(a: Column, b: Column) -> Column:
    """The different values that both arrays have."""
    return F.array_intersect(a, b)


def power(base: Column, exponent: Column) -> Column:
    """An integer power as long; a negative exponent, or a result beyond long, fails the query."""
    refused = F.raise_error(F.lit("negative exponent")).cast("long")
    return F.when(exponent < 0, refused).when(exponent == 0, F.lit(1).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(exponent, F.lit(1))), F.lit(1).cast("long"), lambda p, _: p * base.cast("long")))


def has_duplicates(values: Column) -> Column:
    """Whether a value comes more than once."""
    return F.size(F.array_distinct(values)) < F.size(values)


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular-expression replacements, one after another."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def display(v: Column, indent: int = 2) -> Column:
    """The value as indented text. VARIANT has no such writer, so compact text is laid out in Arrow batches."""
    if indent < 0:
        raise ValueError("indent is negative")

    @F.pandas_udf(T.StringType())
    def lay_out(texts):
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), indent=indent, ensure_ascii=False))

    return lay_out(F.to_json(v))
