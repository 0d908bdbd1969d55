"""VARIANT values as JSON values: kinds, navigation, conversion.

SQL NULL always means absent; JSON null is a variant null. Conversions look at
the kind first, since casts of variants are lax ('"12"' casts to 12).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = "array<variant>"
MEMBERS = "map<string,variant>"
KINDS = ("null", "boolean", "number", "string", "array", "object")
#: Ends the array that a text is parsed in. Texts are older than it, so none can have it.
_MARK = uuid.uuid4().hex
#: Names that a path of variant_get can spell; others are looked up in a map of the members.
_PLAIN = re.compile(r"[^'\"\[\].?\\*]+")


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def parse_tolerant(text: Column) -> Column:
    """The value, or NULL where the text is no JSON document. Trailing content counts as malformed.

    A variant parser stops behind the first value, so the text is parsed as
    the first element of an array that ends with a mark: where the text closes
    the array itself, or holds more than one value, the mark is not second.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_MARK}"]'))).try_cast(NODES)
    return bound(listed, lambda x: F.when((F.size(x) == 2) & (F.get(x, F.lit(1)).try_cast("string") == _MARK), F.get(x, F.lit(0))))


def parse_strict(text: Column) -> Column:
    """The value; a text that is no JSON document, or NULL, fails the query."""
    return F.coalesce(parse_tolerant(text), F.raise_error(F.concat(F.lit("no JSON document: "), F.coalesce(F.left(text, F.lit(100)), F.lit("NULL")))).cast("string").try_cast("variant"))


def _kind(schema: Column) -> Column:
    return (
        F.when(schema == "VOID", "null")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "STRING", "string")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.isNotNull(), "number")
    )


def kind(v: Column) -> Column:
    """null, boolean, number, string, array or object; NULL if absent."""
    return bound(F.schema_of_variant(v), _kind)


#: The type's text by kind of value.
_SCHEMAS = {"null": "^VOID$", "boolean": "^BOOLEAN$", "string": "^STRING$", "array": "^ARRAY", "object": "^OBJECT", "number": "^(?!VOID|BOOLEAN|STRING|ARRAY|OBJECT)"}


def is_kind(v: Column, name: str) -> Column:
    """Two-valued test of the kind; false if absent."""
    return F.coalesce(F.schema_of_variant(v).rlike(_SCHEMAS[name]), F.lit(False))


def missing(v: Column) -> Column:
    """Absent or JSON null."""
    return bound(v, lambda x: x.isNull() | F.is_variant_null(x))


def member(v: Column, name: str) -> Column:
    """The member of that name; NULL if there is none or ``v`` is no object."""
    if _PLAIN.fullmatch(name):
        return F.try_variant_get(v, f"$['{name}']", "variant")
    return F.try_element_at(v.try_cast(MEMBERS), F.lit(name))


def element(v: Column, index: int) -> Column:
    """The element at that place, from the end if negative; NULL if there is none."""
    if index >= 0:
        return F.try_variant_get(v, f"$[{index}]", "variant")
    return F.try_element_at(v.try_cast(NODES), F.lit(index))


def children(v: Column) -> Column:
    """Elements of an array, or values of an object in the order of their names; else none."""
    return bound(v, lambda x: F.coalesce(x.try_cast(NODES), F.map_values(x.try_cast(MEMBERS)), F.array().cast(NODES)))


def value_or_null(v: Column) -> Column:
    """NULL for JSON null, else the value."""
    return F.when(~missing(v), v)


def _finite(d: Column) -> Column:
    """NULL for infinite ones; NaN, which compares as the greatest, too."""
    return F.when((d < F.lit(float("inf"))) & (d > F.lit(float("-inf"))), d)


def _number(v: Column) -> Column:
    return bound(v, lambda x: F.when(is_kind(x, "number"), _finite(x.try_cast("double"))))


def _integer(v: Column) -> Column:
    """Both forms are needed: beyond the range of long the decimal is NULL, and below its scale the double is exact."""

    def whole(x: Column) -> Column:
        return bound(F.struct(x.try_cast("double").alias("d"), x.try_cast("decimal(38,18)").alias("e")), lambda n: F.when((n["d"] == F.floor(n["d"])) & (n["e"] == F.floor(n["e"])), n["e"].try_cast("bigint")))

    return bound(v, lambda x: F.when(is_kind(x, "number"), whole(x)))


def as_double_or_null(v: Column) -> Column:
    """A finite number as double, else NULL."""
    return _number(v)


def as_long_or_null(v: Column) -> Column:
    """A number of integral value (1.0 and 1.23e2 too) in the range of long, else NULL."""
    return _integer(v)


def as_string_or_null(v: Column) -> Column:
    return bound(v, lambda x: F.when(is_kind(x, "string"), x.try_cast("string")))


def as_boolean_or_null(v: Column) -> Column:
    return bound(v, lambda x: F.when(is_kind(x, "boolean"), x.try_cast("boolean")))


def _strictly(lax: Callable[[Column], Column], v: Column, name: str) -> Column:
    def read(x: Column) -> Column:
        said = F.concat(F.lit("a JSON "), F.coalesce(kind(x), F.lit("absence")), F.lit(f" is no {name}: "), F.coalesce(F.left(F.to_json(x), F.lit(80)), F.lit("")))
        return bound(lax(x), lambda y: F.when(y.isNotNull(), y).otherwise(F.raise_error(said)))

    return bound(v, read)


def as_double(v: Column) -> Column:
    """A finite number as double; anything else fails the query."""
    return _strictly(_number, v, "finite number")


def as_long(v: Column) -> Column:
    return _strictly(_integer, v, "integer")


def as_string(v: Column) -> Column:
    return _strictly(as_string_or_null, v, "string")


def as_boolean(v: Column) -> Column:
    return _strictly(as_boolean_or_null, v, "boolean")


def as_members(v: Column) -> Column:
    """An object as a map; anything else fails the query."""
    return _strictly(lambda x: F.when(is_kind(x, "object"), x.try_cast(MEMBERS)), v, "object")


def as_elements(v: Column) -> Column:
    """An array as an array of variants; anything else fails the query."""
    return _strictly(lambda x: F.when(is_kind(x, "array"), x.try_cast(NODES)), v, "array")


def canonical(v: Column) -> Column:
    """Text that is equal for equal values: names sorted, numbers normalised. NULL if absent."""
    return F.to_json(v)


def same(a: Column, b: Column) -> Column:
    """Structural equality; members may come in any order."""
    return canonical(a).eqNullSafe(canonical(b))


def digest(v: Column) -> Column:
    return F.xxhash64(canonical(v))


def escaped(text: Column) -> Column:
    """The text as a JSON string, quotes included."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
