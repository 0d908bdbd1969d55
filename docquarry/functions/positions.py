"""Where in a text something is: reasons and places of rejection, places of values, and messages with both.

VARIANT keeps no offsets, so these read the text again. Columns that accept
stay in the JVM: only rejected texts, and values of a wrong kind, go through
an Arrow batch. Lines and positions count from 0, positions within the line.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..path import first, parse
from .variant import bound, kind, parse_tolerant

PLACE = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("position", T.IntegerType())])
REJECTION = T.StructType([T.StructField("error", T.StringType()), *PLACE.fields])
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+', re.S)
_WORDS = ("NaN", "Infinity", "-Infinity")


def place(text: str, offset: int) -> tuple[int, int]:
    start = text.rfind("\n", 0, offset) + 1
    return text.count("\n", 0, offset), offset - start


def walk(text: str) -> Iterator[tuple[tuple, int, bool]]:
    """(path, offset, whether it is a name) of each value and name of a document, in order; a path holds names and places."""
    held: list[list] = []  # open brackets, each with the name or place that comes now
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token == ",":
            held[-1][1] = held[-1][1] + 1 if held[-1][0] == "[" else None
        elif token in ("]", "}"):
            held.pop()
        elif token != ":":
            is_name = bool(held) and held[-1] == ["{", None]
            if is_name:
                held[-1][1] = json.loads(token)
            yield tuple(k for _, k in held), m.start(), is_name
            if token in ("[", "{"):
                held.append([token, 0 if token == "[" else None])


def rejection(text: str) -> tuple[str, int, int] | None:
    """Why and where a text is no JSON document; None if it is one."""
    twice = []

    def unique(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            twice.append(True)
        return {}

    def refuse(word: str):
        raise json.JSONDecodeError("Unexpected value", text, next((m.start() for m in _TOKEN.finditer(text) if m[0] in _WORDS), 0))

    try:
        json.loads(text, object_pairs_hook=unique, parse_constant=refuse, parse_int=str, parse_float=str)
    except json.JSONDecodeError as e:
        return (e.msg, *place(text, e.pos))
    except RecursionError:
        return "Nested too deeply", 0, 0
    if twice:
        seen = set()
        for path, at, is_name in walk(text):
            if is_name and path in seen:
                return (f"Repeated name: {path[-1]}", *place(text, at))
            if is_name:
                seen.add(path)
    return None


@F.pandas_udf(REJECTION)
def _rejections(texts):
    import pandas as pd

    found = [None if t is None else rejection(t) for t in texts]
    return pd.DataFrame([f or (None, None, None) for f in found], columns=["error", "line", "position"])


def diagnose(text: Column) -> Column:
    """Struct of error, line and position of a rejected text; NULL for a document or an absent text."""
    rejected = F.when(text.isNotNull() & parse_tolerant(text).isNull(), text)
    return bound(_rejections(rejected), lambda x: F.when(x["error"].isNotNull(), x))


def locate(text: Column, path: str) -> Column:
    """Struct of line and position of the value at a path of names and places from the start; NULL if there is none."""
    steps = tuple(s[1] for s in parse(path))

    @F.pandas_udf(PLACE)
    def places(texts):
        import pandas as pd

        def one(t):
            at = next((o for p, o, is_name in walk(t) if p == steps and not is_name), None) if t is not None else None
            return (None, None) if at is None else place(t, at)

        return pd.DataFrame([one(t) for t in texts], columns=["line", "position"])

    return bound(places(text), lambda x: F.when(x["line"].isNotNull(), x))


def pointer(path: tuple) -> str:
    """The path as validation errors name it."""
    return "".join(f"/{x}" for x in path)


def offsets(text: Column, pointers: Column) -> Column:
    """Where the values at the pointers of validation errors begin in the text; -1 for none. Both are columns of a table."""

    @F.pandas_udf("array<int>")
    def found(texts, wanted):
        def one(t, ps):
            if t is None or ps is None or not len(ps):
                return None
            at = {pointer(p): o for p, o, is_name in walk(t) if not is_name}
            return [at.get(p[1:], -1) for p in ps]

        import pandas as pd

        return pd.Series([one(t, p) for t, p in zip(texts, wanted, strict=True)])

    return found(text, pointers)


def crumbs(path: str) -> str:
    """The path as a message names it: a brace before a name, a bracket before a place."""
    return "".join(f"{{{s[1]}" if s[0] == "name" else f"[{s[1]}" for s in parse(path))


# The names of kinds in messages, and the form of the message.
NAMES = {"object": "JsonObject", "array": "JsonArray", "boolean": "JsonBoolean", "null": "JsonNull", "number": "JsonNumber", "string": "JsonString"}
MESSAGE = '%s is not a %s. Path: "%s". Location: line %d, position %d.'


def kind_error(v: Column, text: Column, path: str, wanted: str) -> Column:
    """What is wrong with the kind of the value at a path, and where it stands; NULL if it has the kind or is absent."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    got = kind(first(v, path))
    wrong = F.coalesce(got != wanted, F.lit(False))
    at = locate(F.when(wrong, text), path)
    return F.when(wrong, bound(at, lambda x: F.format_string(MESSAGE, F.element_at(names, got), F.lit(NAMES[wanted]), F.lit(crumbs(path)), x["line"], x["position"])))
