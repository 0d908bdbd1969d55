"""Paths as data: tuples of steps, read with a table of token patterns.

Steps: ("name", n), ("index", i), ("slice", a, b, c), ("all",),
("deep", step), ("filter", test), ("union", steps), ("last",) for the script
``(@.length-1)``, and ("none", text) for any other script, which matches
nothing. Tests: ("or", a, b), ("and", a, b), ("not", a), ("has", names),
("compare", op, a, b), ("true",); operands ("path", names) and ("value", x).
"""

from __future__ import annotations

import re

LAST = "@.length-1"
_BRACKETS = [
    ("all", re.compile(r"\[\*\]")),
    ("filter", re.compile(r"\[\?\(")),
    ("script", re.compile(r"\[\(([^()]*)\)\]")),
    ("names", re.compile(r"""\[\s*((?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")(?:\s*,\s*(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"))*)\s*\]""", re.S)),
    ("slice", re.compile(r"\[\s*(-?\d+)?\s*:\s*(-?\d+)?\s*(?::\s*(-?\d+)?\s*)?\]")),
    ("indices", re.compile(r"\[\s*(-?\d+(?:\s*,\s*-?\d+)*)\s*\]")),
]
_QUOTED = re.compile(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\"""", re.S)
_NAME = re.compile(r"[^.\[]+")
_TOKEN = re.compile(r"""\s*(?:(?P<op>&&|\|\||==|!=|<=|>=|[<>!()])|(?P<path>@(?:\.[A-Za-z0-9_]+)*)|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<word>true|false|null)\b)""", re.S)
COMPARISONS = ("==", "!=", "<=", ">=", "<", ">")
LARGEST = 2**31 - 1


class PathError(ValueError):
    """A path that cannot be read; ``position`` is where."""

    def __init__(self, message: str, path: str, position: int):
        near = f" near {path[position]!r}" if position < len(path) else ""
        super().__init__(f"{message} at {position}{near} in path {path}")
        self.path, self.position = path, position


def _index(digits: str, path: str, at: int) -> int:
    if abs(int(digits)) > LARGEST:
        raise PathError("index out of range", path, at)
    return int(digits)


class _Test:
    """The tests of one filter, by precedence: or, and, not, comparison."""

    def __init__(self, path: str, at: int):
        self.path, self.at = path, at

    def peek(self) -> re.Match | None:
        return _TOKEN.match(self.path, self.at)

    def take(self, *ops: str) -> str | None:
        m = self.peek()
        if m and m["op"] in ops:
            self.at = m.end()
            return m["op"]
        return None

    def chain(self, op: str, name: str, part) -> tuple:
        left = part()
        while self.take(op):
            left = (name, left, part())
        return left

    def any_of(self) -> tuple:
        return self.chain("||", "or", lambda: self.chain("&&", "and", self.one))

    def one(self) -> tuple:
        if self.take("!"):
            return ("not", self.one())
        if self.take("("):
            inner = self.any_of()
            self.close()
            return inner
        left = self.operand()
        op = self.take(*COMPARISONS)
        if op:
            return ("compare", op, left, self.operand())
        return ("has", left[1]) if left[0] == "path" and left[1] else ("true",)

    def close(self) -> None:
        if not self.take(")"):
            raise PathError("expected )", self.path, self.at)

    def operand(self) -> tuple:
        m = self.peek()
        if not m or m["op"]:
            raise PathError("expected a value or @", self.path, self.at)
        self.at = m.end()
        if m["path"]:
            return ("path", tuple(m["path"].split(".")[1:]))
        if m["text"]:
            return ("value", m["text"][1:-1])
        if m["number"]:
            return ("value", float(m["number"]))
        return ("value", {"true": True, "false": False, "null": None}[m["word"]])


def _bracket(path: str, at: int) -> tuple[tuple, int]:
    for name, pattern in _BRACKETS:
        m = pattern.match(path, at)
        if not m:
            continue
        if name == "all":
            return ("all",), m.end()
        if name == "filter":
            test = _Test(path, m.end())
            found = test.any_of()
            test.close()
            if path[test.at : test.at + 1] != "]":
                raise PathError("expected ]", path, test.at)
            return ("filter", found), test.at + 1
        if name == "script":
            return (("last",) if m[1].strip() == LAST else ("none", m[1])), m.end()
        if name == "slice":
            parts = [None if x is None else _index(x, path, at) for x in m.groups()]
            return ("slice", *parts), m.end()
        if name == "names":
            steps = [("name", a if a is not None else b) for a, b in ((q[1], q[2]) for q in _QUOTED.finditer(m[1]))]
        else:
            steps = [("index", _index(x, path, at)) for x in m[1].split(",")]
        return (steps[0] if len(steps) == 1 else ("union", tuple(steps))), m.end()
    raise PathError("unreadable bracket", path, at)


def _step(path: str, at: int) -> tuple[tuple, int]:
    if path.startswith("[", at):
        return _bracket(path, at)
    if not path.startswith(".", at):
        raise PathError("expected . or [", path, at)
    deep = path.startswith("..", at)
    at += 2 if deep else 1
    if deep and path.startswith("[", at):
        step, at = _bracket(path, at)
    elif path.startswith("*", at):
        step, at = ("all",), at + 1
    else:
        m = _NAME.match(path, at)
        if not m:
            raise PathError("expected a name", path, at)
        step, at = ("name", m[0]), m.end()
    return (("deep", step) if deep else step), at


def parse(path: str) -> tuple[tuple, ...]:
    """The steps of a path; the root alone has none."""
    if not path.startswith("$"):
        raise PathError("a path starts with $", path, 0)
    steps, at = [], 1
    while at < len(path):
        step, at = _step(path, at)
        steps.append(step)
    return tuple(steps)


def _value(x) -> str:
    if isinstance(x, str):
        return f"'{x}'"
    if isinstance(x, bool) or x is None:
        return {True: "true", False: "false", None: "null"}[x]
    return str(int(x)) if x == int(x) else str(x)


def _test_text(t: tuple) -> str:
    match t:
        case ("or", a, b):
            return f"({_test_text(a)} || {_test_text(b)})"
        case ("and", a, b):
            return f"({_test_text(a)} && {_test_text(b)})"
        case ("not", a):
            return f"!{_test_text(a)}"
        case ("has", names) | ("path", names):
            return ".".join(["@", *names])
        case ("compare", op, a, b):
            return f"{_test_text(a)} {op} {_test_text(b)}"
        case ("value", x):
            return _value(x)
    return "@"


def text(steps: tuple[tuple, ...]) -> str:
    """The canonical text of a path."""
    out = "$"
    for s in steps:
        match s:
            case ("name", n):
                out += f".{n}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", n) else f"['{n}']"
            case ("index", i):
                out += f"[{i}]"
            case ("slice", a, b, c):
                show = ["" if x is None else str(x) for x in (a, b, c)]
                out += "[" + ":".join(show if c is not None else show[:2]) + "]"
            case ("all",):
                out += ".*"
            case ("deep", inner):
                inside = text((inner,))[1:]
                out += ".." + inside.removeprefix(".")
            case ("filter", t):
                out += f"[?({_test_text(t)})]"
            case ("union", steps_):
                out += "[" + ",".join(f"'{x[1]}'" if x[0] == "name" else str(x[1]) for x in steps_) + "]"
            case ("last",):
                out += f"[({LAST})]"
            case ("none", script):
                out += f"[({script})]"
    return out
