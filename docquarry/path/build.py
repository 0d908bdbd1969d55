"""Paths as Catalyst expressions over a VARIANT column; no shuffle and no Python at run time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.variant import NODES, as_boolean_or_null, as_double_or_null, as_string_or_null, bound, canonical, children, element, member, missing
from .syntax import parse

#: Levels of nesting that a descent looks into; a deeper document fails the query.
DEPTH = 32


def _flat(found: Column, step: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(found, step))


def _present(found: Column, step: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(found, step), lambda x: x.isNotNull())


def _none() -> Column:
    return F.array().cast(NODES)


def _slice(n: Column, start: int | None, stop: int | None, step: int | None) -> Column:
    step = 1 if step is None else step
    if step == 0:
        return _none()

    def taken(listed: Column) -> Column:
        size = F.size(listed)

        def place(x: int) -> Column:
            return F.lit(x) if x >= 0 else size + x

        if step > 0:
            lo = F.lit(0) if start is None else F.least(F.greatest(place(start), F.lit(0)), size)
            hi = (size if stop is None else F.least(F.greatest(place(stop), F.lit(0)), size)) - 1
            some = lo <= hi
        else:
            lo = size - 1 if start is None else F.greatest(F.least(place(start), size - 1), F.lit(0))
            hi = F.lit(0) if stop is None else F.greatest(place(stop), F.lit(-1)) + 1
            some = lo >= hi
        some = some & (size > 0)
        # a range that is empty must not reach sequence(), which refuses a wrong direction
        span = F.sequence(F.when(some, lo).otherwise(0), F.when(some, hi).otherwise(0), F.lit(step))
        return F.when(some, F.transform(span, lambda i: F.get(listed, i))).otherwise(_none())

    return bound(F.coalesce(n.try_cast(NODES), _none()), taken)


def _descend(found: Column, depth: int) -> Column:
    """The nodes and all below them, level by level."""
    start = F.struct(_none().alias("done"), found.alias("edge"))

    def deeper(s: Column, _: Column) -> Column:
        return F.struct(F.concat(s["done"], s["edge"]).alias("done"), F.flatten(F.transform(s["edge"], children)).alias("edge"))

    def check(s: Column) -> Column:
        return F.when(F.size(s["edge"]) > 0, F.raise_error(F.lit(f"document deeper than {depth} levels")).try_cast("string").cast("variant").isNull().cast("int")).otherwise(0)

    walked = F.aggregate(F.sequence(F.lit(0), F.lit(depth)), start, deeper, lambda s: F.struct(s["done"].alias("done"), check(s).alias("deep")))
    return bound(walked, lambda w: F.when(w["deep"] == 0, w["done"]).otherwise(_none()))


def _operand(o: tuple, x: Column) -> Column:
    for name in o[1]:
        x = member(x, name)
    return x


def _ordered(op: str, a: Column, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _units(text: Column) -> Column:
    """What orders texts by UTF-16 units, where characters above U+FFFF come before those from U+E000 on."""
    return F.encode(text, "UTF-16BE")


def _before_surrogates(text: str) -> bool:
    """Whether a text compares with all others in one order by code points and by units."""
    return all(c < "\ud800" for c in text)


_READ = {float: as_double_or_null, str: as_string_or_null, bool: as_boolean_or_null}
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _with_value(op: str, v: Column, value) -> Column:
    """A node against a literal: only the reading of the literal's kind is needed."""
    differ = op == "!="
    if value is None:
        return missing(v) if op == "==" else ~missing(v) if differ else F.lit(False)
    if isinstance(value, bool) and op not in ("==", "!="):
        return F.lit(False)
    got, wanted = _READ[type(value)](v), F.lit(value)
    if isinstance(value, str) and op not in ("==", "!=") and not _before_surrogates(value):
        got, wanted = _units(got), _units(wanted)
    return F.coalesce(_ordered(op, got, wanted), F.lit(differ))


def _with_node(op: str, a: Column, b: Column) -> Column:
    """Two nodes: numbers and texts by value, all else by equality alone; null and absent are one."""

    def compared(x: Column) -> Column:
        a, b = x["a"], x["b"]
        if op in ("==", "!="):
            equal = F.when(missing(a) | missing(b), missing(a) & missing(b)).otherwise(F.coalesce(as_double_or_null(a) == as_double_or_null(b), canonical(a) == canonical(b)))
            return equal if op == "==" else ~equal
        return F.coalesce(_ordered(op, as_double_or_null(a), as_double_or_null(b)), _ordered(op, _units(as_string_or_null(a)), _units(as_string_or_null(b))), F.lit(False))

    return bound(F.struct(a.alias("a"), b.alias("b")), compared)


def _same_kind(op: str, a, b) -> bool:
    """Two literals."""
    if a is None or b is None or type(a) is not type(b):
        return {"==": a is b, "!=": a is not b}.get(op, False)
    if op in ("==", "!="):
        return (a == b) == (op == "==")
    if isinstance(a, str):
        a, b = a.encode("utf-16-be"), b.encode("utf-16-be")
    return not isinstance(a, bool) and {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _compare(op: str, a: tuple, b: tuple, x: Column) -> Column:
    if a[0] == "value" == b[0]:
        return F.lit(_same_kind(op, a[1], b[1]))
    if a[0] == "value":
        return _with_value(_TURNED.get(op, op), _operand(b, x), a[1])
    if b[0] == "value":
        return _with_value(op, _operand(a, x), b[1])
    return _with_node(op, _operand(a, x), _operand(b, x))


def test(t: tuple, x: Column) -> Column:
    """A filter's test of node ``x``, true or false and never NULL."""
    match t:
        case ("or", a, b):
            return test(a, x) | test(b, x)
        case ("and", a, b):
            return test(a, x) & test(b, x)
        case ("not", a):
            return ~test(a, x)
        case ("has", names):
            return _operand(("path", names), x).isNotNull()
        case ("compare", op, a, b):
            return F.coalesce(_compare(op, a, b, x), F.lit(False))
    return F.lit(True)


def _apply(step: tuple, found: Column, depth: int) -> Column:
    match step:
        case ("name", n):
            return _present(found, lambda x: member(x, n))
        case ("index", i):
            return _present(found, lambda x: element(x, i))
        case ("last",):
            return _present(found, lambda x: element(x, -1))
        case ("slice", a, b, c):
            return _flat(found, lambda x: _slice(x, a, b, c))
        case ("all",):
            return _flat(found, children)
        case ("filter", t):
            return _flat(found, lambda x: F.filter(F.coalesce(x.try_cast(NODES), _none()), lambda y: test(t, y)))
        case ("union", steps):
            return _flat(found, lambda x: F.concat(*[_apply(s, F.array(x), depth) for s in steps]))
        case ("deep", target):
            if target[0] not in ("name", "all", "index"):
                return F.filter(found, lambda x: F.lit(False))
            return _apply(target, _descend(found, depth), depth)
    return F.filter(found, lambda x: F.lit(False))


def single(path: str) -> bool:
    """Whether the path can match one node at most."""
    return all(s[0] in ("name", "index", "last") for s in parse(path))


def first(v: Column, path: str, depth: int = DEPTH) -> Column:
    """The first match, NULL if there is none; a path of names and places needs no list."""
    if not single(path):
        return F.get(nodes(v, path, depth), F.lit(0))
    for s in parse(path):
        v = member(v, s[1]) if s[0] == "name" else element(v, s[1] if s[0] == "index" else -1)
    return v


def nodes(v: Column, path: str, depth: int = DEPTH) -> Column:
    """All matches as array<variant>, repeated ones too; empty if ``v`` is NULL.

    The order is that of the document for arrays; members come by name.
    """
    steps = parse(path)
    lead = 0
    while lead < len(steps) and steps[lead][0] in ("name", "index", "last"):
        lead += 1
    for s in steps[:lead]:
        v = member(v, s[1]) if s[0] == "name" else element(v, s[1] if s[0] == "index" else -1)
    if lead == len(steps):
        return F.array_compact(F.array(v))
    found = F.array(v)  # steps find nothing in an absent node
    for s in steps[lead:]:
        found = _apply(s, found, depth)
    return found


def exists(v: Column, path: str, depth: int = DEPTH) -> Column:
    """Whether the path matches anything."""
    if single(path):
        return first(v, path, depth).isNotNull()
    return F.size(nodes(v, path, depth)) > 0


__all__ = ["DEPTH", "exists", "first", "nodes", "single", "test"]
