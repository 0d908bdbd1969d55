"""JSON Type Definition (RFC 8927): schemas checked on the driver, instances in column expressions.

``compile_schema`` reads a schema and raises SchemaError on every rule it
breaks. ``errors`` gives the errors of an instance as an array column of
(ptr, code, message, schema, via), sorted, where ``schema`` is the RFC's path
of the broken rule and ``via`` the way to the value in words; ``verbose`` adds
the value itself to the message. ``valid`` says whether there are none,
``rendered`` writes errors as lines, with offsets where the text is given, and
``spark_type`` is the Spark type that instances fit. References are put in place;
those that recurse go ``depth`` levels deep, and a deeper instance fails the
query rather than pass unseen.

A nullable form is checked inside, a reference to properties is checked for
missing and additional ones, and unknown keywords are refused in every form,
as the RFC has it. ``lenient=True`` gives the behaviour of a well-known
implementation that does none of these three.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.positions import offsets
from ..functions.variant import MEMBERS, NODES, bound, is_kind, kind, member, missing

DEPTH = 6
#: Lowest and highest value of the integer types.
RANGES = {f"{u}int{n}": (0 if u else -(2 ** (n - 1)), 2 ** (n - (not u)) - 1) for n in (8, 16, 32) for u in ("", "u")}
TYPES = {"boolean", "string", "timestamp", "float32", "float64", *RANGES}
FORMS = ("ref", "type", "enum", "elements", "properties", "values", "discriminator")
_WITH = {"properties": {"properties", "optionalProperties", "additionalProperties"}, "discriminator": {"discriminator", "mapping"}}
_SHARED = {"nullable", "metadata"}
ERROR = "array<struct<ptr:string,code:string,message:string,schema:string,via:string>>"
# The catalogue of messages.
UNKNOWN_TYPE = "unknown type: '%s'"
EXPECTED_BOOLEAN = "expected boolean, got %s"
EXPECTED_STRING = "expected string, got %s"
EXPECTED_TIMESTAMP = "expected timestamp (string), got %s"
EXPECTED_INTEGER = "expected integer, got float"
EXPECTED_NUMERIC_TYPE = "expected %s, got %s"
EXPECTED_ARRAY = "expected array, got %s"
EXPECTED_OBJECT = "expected object, got %s"
VALUE_NOT_IN_ENUM = "value '%s' not in enum: %s"
EXPECTED_STRING_FOR_ENUM = "expected string for enum, got %s"
MISSING_REQUIRED_PROPERTY = "missing required property: '%s'"
ADDITIONAL_PROPERTY_NOT_ALLOWED = "additional property not allowed: '%s'"
DISCRIMINATOR_MUST_BE_STRING = "discriminator '%s' must be a string"
DISCRIMINATOR_VALUE_NOT_IN_MAPPING = "discriminator value '%s' not in mapping"
#: RFC 3339, with a leap second.
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"


class SchemaError(ValueError):
    """A schema that breaks a rule of the RFC."""


@dataclass
class Schema:
    """One form; ``inner`` holds the schemas below by their names."""

    form: str
    nullable: bool = False
    name: str = ""  # of the type, the reference or the tag
    values: tuple[str, ...] = ()
    required: dict[str, Schema] = field(default_factory=dict)
    optional: dict[str, Schema] = field(default_factory=dict)
    extra: bool = False
    inner: dict[str, Schema] = field(default_factory=dict)
    definitions: dict[str, Schema] = field(default_factory=dict)


def _need(ok: bool, said: str) -> None:
    if not ok:
        raise SchemaError(said)


def compile_schema(schema: str | dict, lenient: bool = False) -> Schema:
    """The schema as a tree; a dict, or its JSON text."""
    raw = json.loads(schema) if isinstance(schema, str) else schema
    _need(isinstance(raw, dict), "a schema is an object")
    definitions = raw.get("definitions", {})
    _need(isinstance(definitions, dict), "definitions is an object")
    names = set(definitions)
    root = _compile(raw, names, True, lenient)
    root.definitions = {k: _compile(v, names, False, lenient) for k, v in definitions.items()}
    for start in root.definitions:
        seen, at = {start}, root.definitions[start]
        while at.form == "ref":
            _need(at.name not in seen, f"reference {start} leads to itself alone")
            seen.add(at.name)
            at = root.definitions[at.name]
    return root


def _compile(raw, names: set[str], root: bool, lenient: bool) -> Schema:
    _need(isinstance(raw, dict), "a schema is an object")
    _need(root or "definitions" not in raw, "definitions stand at the root only")
    has = {f for f in FORMS if f in raw}
    if raw.keys() & {"optionalProperties"}:
        has.add("properties")
    _need(len(has) <= 1, f"more than one form: {', '.join(sorted(has))}")
    form = next(iter(has), "empty")
    known = _WITH.get(form, {form}) | _SHARED | ({"definitions"} if root else set())
    refused = raw.keys() - known
    if lenient and form not in ("type", "empty"):
        refused &= {"properties", "optionalProperties", "additionalProperties", "mapping"}
    _need(not refused, f"keywords that form {form} does not have: {', '.join(sorted(refused))}")
    nullable = raw.get("nullable", False)
    _need(isinstance(nullable, bool), "nullable is true or false")
    _need(isinstance(raw.get("metadata", {}), dict), "metadata is an object")
    out = Schema(form, nullable)
    below = lambda x: _compile(x, names, False, lenient)
    if form == "ref":
        _need(isinstance(raw["ref"], str) and raw["ref"] in names, "ref names a definition")
        out.name = raw["ref"]
    elif form == "type":
        _need(isinstance(raw["type"], str), "type is a string")
        _need(raw["type"] in TYPES, UNKNOWN_TYPE % raw["type"])
        out.name = raw["type"]
    elif form == "enum":
        e = raw["enum"]
        _need(isinstance(e, list) and bool(e) and all(isinstance(x, str) for x in e) and len(set(e)) == len(e), "enum is a list of different strings, one at least")
        out.values = tuple(e)
    elif form in ("elements", "values"):
        out.inner = {"": below(raw[form])}
    elif form == "properties":
        for key in ("properties", "optionalProperties"):
            _need(isinstance(raw.get(key, {}), dict), f"{key} is an object")
        out.required = {k: below(x) for k, x in raw.get("properties", {}).items()}
        out.optional = {k: below(x) for k, x in raw.get("optionalProperties", {}).items()}
        _need(not out.required.keys() & out.optional.keys(), "a property is required or optional, not both")
        out.extra = raw.get("additionalProperties", False)
        _need(isinstance(out.extra, bool), "additionalProperties is true or false")
    elif form == "discriminator":
        _need(isinstance(raw["discriminator"], str), "discriminator is a string")
        _need(isinstance(raw.get("mapping"), dict), "discriminator comes with a mapping")
        out.name = raw["discriminator"]
        out.inner = {k: below(x) for k, x in raw["mapping"].items()}
        for k, x in out.inner.items():
            _need(x.form == "properties" and not x.nullable, f"mapping {k} is of form properties and not nullable")
            _need(out.name not in x.required | x.optional, f"mapping {k} has the tag {out.name} as a property")
    else:
        _need("mapping" not in raw, "mapping comes with a discriminator")
    return out


@dataclass
class _At:
    """A place in the instance (pointer, and words) and in the schema, and how errors are told."""

    ptr: Column
    via: Column
    schema: str
    verbose: bool

    def field(self, name: str | Column, schema: str) -> _At:
        name = F.lit(name) if isinstance(name, str) else name
        return _At(F.concat(self.ptr, F.lit("/"), name), F.concat(self.via, F.lit("→field:"), name), self.schema + schema, self.verbose)

    def item(self, i: Column, schema: str) -> _At:
        return _At(F.concat(self.ptr, F.lit("/"), i.cast("string")), F.concat(self.via, F.lit("→item:"), i.cast("string")), self.schema + schema, self.verbose)

    def within(self, schema: str, whole: bool = False) -> _At:
        return _At(self.ptr, self.via, schema if whole else self.schema + schema, self.verbose)

    def error(self, code: str, v: Column, template: str, *args: Column | str, rule: str = "") -> Column:
        """One error as a struct; ``v`` is the value that a verbose message shows."""
        said = F.format_string(template, *[F.lit(a) if isinstance(a, str) else a for a in args]) if args else F.lit(template)
        if self.verbose:
            said = F.concat(said, F.lit(" (was: "), F.coalesce(F.to_json(v), F.lit("null")), F.lit(")"))
        return F.struct(self.ptr.alias("ptr"), F.lit(code).alias("code"), said.alias("message"), F.lit(self.schema + rule).alias("schema"), self.via.alias("via"))


def _none() -> Column:
    return F.array().cast(ERROR)


def _unless(ok: Column, error: Column) -> Column:
    return F.when(ok, _none()).otherwise(F.array(error))


def is_timestamp(text: Column) -> Column:
    """An RFC 3339 time of a day that exists; a leap second counts as the second before."""
    plain = F.regexp_replace(F.upper(text), r"^(.{17})60", "$159")
    plain = F.regexp_replace(plain, r"\.(\d{1,6})\d*", r".$1")
    return F.coalesce(text.rlike(TIMESTAMP) & F.try_to_timestamp(plain).isNotNull(), F.lit(False))


def _type_ok(name: str, v: Column) -> Column:
    if name in ("boolean", "string"):
        return is_kind(v, name)
    if name == "timestamp":
        return is_kind(v, "string") & bound(v.try_cast("string"), is_timestamp)
    if name.startswith("float"):
        return is_kind(v, "number")
    low, high = RANGES[name]
    inside = bound(v.try_cast("double"), lambda d: (d >= low) & (d <= high) & (d == F.floor(d)))
    return is_kind(v, "number") & F.coalesce(inside, F.lit(False))


def _type_error(name: str, v: Column, at: _At) -> Column:
    got = kind(v)
    if name == "boolean":
        return at.error("type", v, EXPECTED_BOOLEAN, got, rule="/type")
    if name == "string":
        return at.error("type", v, EXPECTED_STRING, got, rule="/type")
    if name == "timestamp":
        return at.error("type", v, EXPECTED_TIMESTAMP, got, rule="/type")
    if name.startswith("float"):
        return at.error("type", v, EXPECTED_NUMERIC_TYPE, name, got, rule="/type")
    broken = bound(v.try_cast("double"), lambda d: d != F.floor(d))
    return (
        F.when(got != "number", at.error("type", v, EXPECTED_NUMERIC_TYPE, name, got, rule="/type"))
        .when(F.coalesce(broken, F.lit(False)), at.error("type", v, EXPECTED_INTEGER, rule="/type"))
        .otherwise(at.error("type", v, EXPECTED_NUMERIC_TYPE, name, "out of range", rule="/type"))
    )


def errors(v: Column, schema: Schema, depth: int = DEPTH, lenient: bool = False, verbose: bool = False) -> Column:
    """The instance's errors, sorted by pointer and code; NULL for a NULL (absent) instance."""
    root = _At(F.lit("#"), F.lit("#"), "", verbose)
    return bound(v, lambda x: F.when(x.isNotNull(), F.array_sort(_errors(x, schema, root, schema.definitions, depth, None, lenient))))


def valid(v: Column, schema: Schema, depth: int = DEPTH, lenient: bool = False) -> Column:
    """Whether the instance has no errors; NULL for a NULL (absent) instance. A test of its own, which ends at the first thing that is wrong and builds no messages."""
    return bound(v, lambda x: F.when(x.isNotNull(), _fits(x, schema, schema.definitions, depth, None, lenient)))


def _fits(v: Column, s: Schema, defs: dict[str, Schema], depth: int, tag: str | None, lenient: bool) -> Column:
    """True or false, never NULL."""
    fits = bound(v, lambda x: _form_fits(x, s, defs, depth, tag, lenient))
    return missing(v) | fits if s.nullable else fits


def _form_fits(v: Column, s: Schema, defs: dict[str, Schema], depth: int, tag: str | None, lenient: bool) -> Column:
    below = lambda x, sub, t=None: _fits(x, sub, defs, depth, t, lenient)
    inside = not (lenient and s.nullable)
    no = F.lit(False)
    if s.form == "ref":
        if depth == 0:
            return F.raise_error(F.lit("instance deeper than the references go")).cast("boolean")
        target = defs[s.name]
        if lenient and target.form == "properties":
            target = Schema("properties", target.nullable, required={}, optional={**target.required, **target.optional}, extra=True)
        return _fits(v, target, defs, depth - 1, tag, lenient)
    if s.form == "type":
        return _type_ok(s.name, v)
    if s.form == "enum":
        return is_kind(v, "string") & F.coalesce(v.try_cast("string").isin(*s.values), no)
    if s.form == "elements":
        each = F.coalesce(F.forall(v.try_cast(NODES), lambda x: below(x, s.inner[""])), no) if inside else F.lit(True)
        return is_kind(v, "array") & each
    if s.form == "values":
        each = F.coalesce(F.forall(F.map_values(v.try_cast(MEMBERS)), lambda x: below(x, s.inner[""])), no) if inside else F.lit(True)
        return is_kind(v, "object") & each
    if s.form == "properties":
        if not inside:
            return is_kind(v, "object")

        def absent_or(sub: Schema) -> Callable[[Column], Column]:
            return lambda x: F.when(x.isNull(), F.lit(True)).otherwise(below(x, sub))

        def checked(members: Column) -> Column:
            ok = F.lit(True)
            for k in s.required:
                ok = ok & F.map_contains_key(members, k)
            if not s.extra:
                allowed = [*s.required, *s.optional, *([tag] if tag else [])]
                ok = ok & (F.forall(F.map_keys(members), lambda k: k.isin(*allowed)) if allowed else F.size(members) == 0)
            for k, sub in {**s.required, **s.optional}.items():
                ok = ok & bound(F.try_element_at(members, F.lit(k)), absent_or(sub))
            return ok

        return is_kind(v, "object") & F.coalesce(bound(v.try_cast(MEMBERS), checked), no)
    if s.form == "discriminator":

        def chosen(text: Column) -> Column:
            out = no
            for k, sub in s.inner.items():
                out = F.when(text == k, below(v, sub, s.name) if inside else F.lit(True)).otherwise(out)
            return out

        named = lambda name: is_kind(name, "string") & F.coalesce(bound(name.try_cast("string"), chosen), no)
        return is_kind(v, "object") & F.coalesce(bound(member(v, s.name), named), no)
    return F.lit(True)


def rendered(found: Column, text: Column | None = None) -> Column:
    """Errors as lines with offset, pointer and way; the offset is -1 unless the text is given.

    With the text, ``found`` must be a column of the table, since Spark hands
    no expression with a lambda to Python. Only texts with errors are read again.
    """

    def line(e: Column, off: Column) -> Column:
        return F.format_string("[off=%d ptr=%s via=%s] %s", off, e["ptr"], e["via"], e["message"])

    if text is None:
        return F.transform(found, lambda e: line(e, F.lit(-1)))
    at = offsets(F.when(F.size(found) > 0, text), found["ptr"])
    return F.zip_with(found, F.coalesce(at, F.array().cast("array<int>")), lambda e, off: line(e, F.coalesce(off, F.lit(-1))))


def _errors(v: Column, s: Schema, at: _At, defs: dict[str, Schema], depth: int, tag: str | None, lenient: bool) -> Column:
    found = _form(v, s, at, defs, depth, tag, lenient)
    if not s.nullable:
        return found
    return F.when(missing(v), _none()).otherwise(found)


def _form(v: Column, s: Schema, at: _At, defs: dict[str, Schema], depth: int, tag: str | None, lenient: bool) -> Column:
    below = lambda x, sub, place, t=None: _errors(x, sub, place, defs, depth, t, lenient)
    inside = not (lenient and s.nullable)
    got = kind(v)
    if s.form == "ref":
        if depth == 0:
            said = F.concat(F.lit("instance deeper than the references go, at "), at.ptr)
            return F.array(at.error("depth", v, "%s", F.raise_error(said).cast("string")))
        target = defs[s.name]
        if lenient and target.form == "properties":
            target = Schema("properties", target.nullable, required={}, optional={**target.required, **target.optional}, extra=True)
        return _errors(v, target, at.within(f"/definitions/{s.name}", whole=True), defs, depth - 1, tag, lenient)
    if s.form == "type":
        return _unless(_type_ok(s.name, v), _type_error(s.name, v, at))
    if s.form == "enum":
        listed = f"[{', '.join(s.values)}]"

        def known(text: Column) -> Column:
            return _unless(text.isin(*s.values), at.error("enum", v, VALUE_NOT_IN_ENUM, text, listed, rule="/enum"))

        return F.when(is_kind(v, "string"), bound(v.try_cast("string"), known)).otherwise(F.array(at.error("enum", v, EXPECTED_STRING_FOR_ENUM, got, rule="/enum")))
    if s.form == "elements":
        each = F.flatten(F.transform(v.try_cast(NODES), lambda x, i: below(x, s.inner[""], at.item(i, "/elements")))) if inside else _none()
        return F.when(is_kind(v, "array"), each).otherwise(F.array(at.error("elements", v, EXPECTED_ARRAY, got, rule="/elements")))
    not_object = lambda rule: F.array(at.error(s.form, v, EXPECTED_OBJECT, got, rule=rule))
    if s.form == "values":
        each = F.flatten(F.transform(F.map_entries(v.try_cast(MEMBERS)), lambda e: below(e["value"], s.inner[""], at.field(e["key"], "/values")))) if inside else _none()
        return F.when(is_kind(v, "object"), each).otherwise(not_object("/values"))
    if s.form == "properties":
        return F.when(is_kind(v, "object"), _properties(v, s, at, tag, below) if inside else _none()).otherwise(not_object("/properties" if s.required or not s.optional else "/optionalProperties"))
    if s.form == "discriminator":
        named = at.field(s.name, "")

        def tagged(name: Column) -> Column:
            def chosen(text: Column) -> Column:
                out = F.array(named.error("mapping", name, DISCRIMINATOR_VALUE_NOT_IN_MAPPING, text, rule="/mapping"))
                if not inside:
                    return F.when(F.coalesce(text.isin(*s.inner), F.lit(False)), _none()).otherwise(out)
                for k, sub in s.inner.items():
                    out = F.when(text == k, below(v, sub, at.within(f"/mapping/{k}"), s.name)).otherwise(out)
                return out

            return (
                F.when(name.isNull(), F.array(at.error("discriminator", v, DISCRIMINATOR_MUST_BE_STRING, s.name, rule="/discriminator")))
                .when(~is_kind(name, "string"), F.array(named.error("discriminator", name, DISCRIMINATOR_MUST_BE_STRING, s.name, rule="/discriminator")))
                .otherwise(bound(name.try_cast("string"), chosen))
            )

        return F.when(~is_kind(v, "object"), not_object("/discriminator")).otherwise(bound(member(v, s.name), tagged))
    return _none()


def _if_there(below, sub: Schema, at: _At) -> Callable[[Column], Column]:
    return lambda x: F.when(x.isNotNull(), below(x, sub, at)).otherwise(_none())


def _properties(v: Column, s: Schema, at: _At, tag: str | None, below) -> Column:
    """The members become a map once; every test reads that."""

    def checked(members: Column) -> Column:
        parts = [_unless(F.map_contains_key(members, k), at.error("missing", v, MISSING_REQUIRED_PROPERTY, k, rule=f"/properties/{k}")) for k in s.required]
        if not s.extra:
            allowed = [*s.required, *s.optional, *([tag] if tag else [])]
            more = F.filter(F.map_keys(members), lambda k: ~k.isin(*allowed)) if allowed else F.map_keys(members)
            parts.append(F.transform(more, lambda k: at.field(k, "").error("additional", members[k], ADDITIONAL_PROPERTY_NOT_ALLOWED, k)))
        for k, sub in {**s.required, **s.optional}.items():
            place = at.field(k, f"/{'properties' if k in s.required else 'optionalProperties'}/{k}")
            parts.append(bound(F.try_element_at(members, F.lit(k)), _if_there(below, sub, place)))
        return F.flatten(F.array(*parts)) if parts else _none()

    return bound(v.try_cast(MEMBERS), checked)


_SPARK = {"boolean": T.BooleanType(), "string": T.StringType(), "timestamp": T.TimestampType(), "float32": T.DoubleType(), "float64": T.DoubleType()} | {
    "int8": T.ByteType(), "uint8": T.ShortType(), "int16": T.ShortType(), "uint16": T.IntegerType(), "int32": T.IntegerType(), "uint32": T.LongType(),
}


def spark_type(s: Schema, definitions: dict[str, Schema] | None = None, inside: tuple[str, ...] = ()) -> T.DataType:
    """A type for instances that are valid; what is recursive, tagged or open is VARIANT."""
    defs = s.definitions if definitions is None else definitions
    if s.form == "ref":
        return T.VariantType() if s.name in inside else spark_type(defs[s.name], defs, (*inside, s.name))
    if s.form == "type":
        return _SPARK[s.name]
    if s.form == "enum":
        return T.StringType()
    if s.form == "elements":
        return T.ArrayType(spark_type(s.inner[""], defs, inside))
    if s.form == "values":
        return T.MapType(T.StringType(), spark_type(s.inner[""], defs, inside))
    if s.form == "properties":
        return T.StructType([T.StructField(k, spark_type(x, defs, inside), k in s.optional or x.nullable) for k, x in {**s.required, **s.optional}.items()])
    return T.VariantType()
