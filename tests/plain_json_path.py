"""A slow evaluator of parsed paths on plain Python values, to hold the columns against."""


def kind(x):
    return "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, int | float) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object"


MISSING = object()


def resolve(o, x):
    if o[0] == "value":
        return o[1]
    for n in o[1]:
        x = x.get(n, MISSING) if isinstance(x, dict) else MISSING
    return x


def holds(t, x):
    if t[0] == "or":
        return holds(t[1], x) or holds(t[2], x)
    if t[0] == "and":
        return holds(t[1], x) and holds(t[2], x)
    if t[0] == "not":
        return not holds(t[1], x)
    if t[0] == "has":
        return resolve(("path", t[1]), x) is not MISSING
    if t[0] == "true":
        return True
    op, a, b = t[1], resolve(t[2], x), resolve(t[3], x)
    a, b = (None if y is MISSING else y for y in (a, b))
    if a is None or b is None:
        return {"==": a is b, "!=": a is not b}.get(op, False)
    if kind(a) != kind(b):
        return op == "!="
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    if kind(a) not in ("number", "string"):
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def children(x):
    return list(x) if isinstance(x, list) else [x[k] for k in sorted(x)] if isinstance(x, dict) else []


def step(s, x):
    if s[0] == "name":
        return [x[s[1]]] if isinstance(x, dict) and s[1] in x else []
    if s[0] == "all":
        return children(x)
    if s[0] == "union":
        return [y for part in s[1] for y in step(part, x)]
    if s[0] == "deep":
        if s[1][0] not in ("name", "all", "index"):
            return []
        out, level = [], [x]
        while level:
            out += [y for n in level for y in step(s[1], n)]
            level = [c for n in level for c in children(n)]
        return out
    if not isinstance(x, list):
        return []
    if s[0] in ("index", "last"):
        i = -1 if s[0] == "last" else s[1]
        return [x[i]] if -len(x) <= i < len(x) else []
    if s[0] == "filter":
        return [y for y in x if holds(s[1], y)]
    if s[0] == "slice":
        a, b, c = s[1:]
        c = 1 if c is None else c
        if c == 0 or not x:
            return []
        if c < 0 and a is not None and a < -len(x):
            a = 0  # a start before the list stands for its first element
        return x[a:b:c]
    return []


def evaluate(steps, x):
    found = [x]
    for s in steps:
        found = [y for n in found for y in step(s, n)]
    return found
