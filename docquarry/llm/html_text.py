"""Main text of HTML pages by tag-path ratios.

A tolerant scan gives the text of each block with its tag path from the root,
each tag with its first class. For each path of a page, the length of text
outside links and its punctuation are summed and divided by the path's blocks.
Both ratios are smoothed along the tree of paths: part is a path's own, the rest that of the container
it stands in, or of one further up, less for each level between; a short list item
so shares the ratio of the paragraphs around it, and an advert beside
the article that of its own kind. They are fused: length times the logarithm
of punctuation, times the container's share of the page's text, times the share of
the path's text that is no link, and times ``NAMED`` where a class or id on the path says advert, notice,
sidebar, menu or comments. A heading's ratio comes from the text that follows it. The paths whose fused ratio reaches a
share of the page's greatest are content, and the text is that of all their blocks in page order; there is no
other way in. A path so named needs much text besides, so that a page with nothing but an advert has no text.

Text that is no article's by the element it is in is no candidate: menus (nav, menu), page headers,
footers, asides, forms and their controls, dialogs, scripts, styles and what else browsers do not show, hidden elements, and inline
elements named as above, which are cut out of the block around them.

Null and empty pages give the empty text. Unclosed, crossing or cut-off tags
and references are read as browsers do; deep, wide and very long pages take
time in proportion to their length. Paths of equal ratios are all content or
none. Repeated rows give the same text; an
empty table gives an empty table; columns named like an output are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, slices, texts

SLICE = 4 << 20
#: A path is content from this share of the page's greatest fused ratio on.
LEAST = 0.08
#: How much of a smoothed ratio is a path's own, what is left of a container's for each level between it and a path, and of the following text's for a heading.
OWN, DECAY, AHEAD = 0.3, 0.7, 1.0
#: What a name that says advert, notice, sidebar, menu or comments leaves of a path's fused ratio,
#: and the least that must be left for such a path to be content: blocks of about 200 signs each.
NAMED, NAMED_LEAST = 0.05, 20.0
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Fixed values of HTML: elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("nav footer aside form script style head noscript iframe template button select textarea dialog menu title".split())
CLOSES_P = BLOCK - {"body", "html", "option", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: What an opening tag closes, and the elements that hide such an ancestor.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|"
    r"sidebar|side-?bar|widget|rail|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|masthead|site-?header|page-?header|topbar|site-?footer|page-?footer|footer|"
    r"comments?|commentlist|comment-?list|respond|replies|reply|disqus|discussion|responses|reader-?comments|user-?comments|"
    r"share|sharing|social|related|recommend\w*|trending|most-?read|read-?more|teasers?|outbrain|taboola|copyright|legal|skip-?link|hidden|search)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""", re.I | re.S)
_CLASS = re.compile(r"""(?:^|[\s"'])class\s*=\s*["']?\s*([\w-]+)""", re.I)
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")
_STATED = re.compile(r"(?<![\w-])(?:with|without|has|no|non)[-_][\w-]+", re.I)
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?…。，；：！？¿¡]")


def _judge(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element and all in it is no candidate, and whether a class or id names it as no part of an article; ``inside``: within an article or main."""
    if tag in SKIPPED or (tag == "header" and not inside):
        return True, False
    named = False
    if not attributes or tag in ("html", "body"):
        return False, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, named
        if name == "role" and value.lower().strip() in ROLES:
            return True, named
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, named
        if name in ("class", "id") and tag != "main" and HINT.search(_STATED.sub("", _CAMEL.sub("-", value))):
            named = True
    return named and tag not in BLOCK, named


class Paths:
    """Tag paths as numbers: each has the number of the path above it, its last step, and whether a step of it is named as no part of an article (such steps end with "!"). The root is 0."""

    def __init__(self) -> None:
        self.above, self.step, self.named = [-1], [""], [False]
        self.below: dict[tuple[int, str], int] = {}

    def down(self, path: int, step: str) -> int:
        found = self.below.get((path, step))
        if found is None:
            found = self.below[path, step] = len(self.above)
            self.above.append(path)
            self.step.append(step)
            self.named.append(self.named[path] or step.endswith("!"))
        return found


class Open:
    """The open elements: tag, whether unwanted, step in the path; and with all below them, whether unwanted, the path, and how many are blocks."""

    def __init__(self, paths: Paths):
        self.paths = paths
        self.stack: list[tuple[str, bool, str, bool, int, int]] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)

    @property
    def state(self) -> tuple[int, bool]:
        """Path, and whether text here is a candidate."""
        return (self.stack[-1][4], not self.stack[-1][3]) if self.stack else (0, True)

    def blocks_from(self, index: int) -> int:
        return self.stack[-1][5] - (self.stack[index - 1][5] if index else 0)

    def push(self, tag: str, unwanted: bool, step: str) -> None:
        path, candidate = self.state
        blocks = (self.stack[-1][5] if self.stack else 0) + (tag in BLOCK)
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, unwanted, step, unwanted or not candidate, self.paths.down(path, step) if step else path, blocks))

    def last(self, tags: set[str], hide: set[str] = frozenset()) -> int:
        """The place of the last open element of ``tags`` that none of ``hide`` stands behind; -1 if there is none."""
        found, hidden = (max((self.places[t][-1] for t in some if self.places[t]), default=-1) for some in (tags, hide))
        return found if found > hidden else -1

    def cut(self, index: int, keep: list[tuple] = ()) -> None:
        """Close all from ``index`` on but for those in ``keep``."""
        for x in self.stack[index:]:
            self.places[x[0]].pop()
        del self.stack[index:]
        for x in keep:
            self.push(*x[:3])


def blocks(page: str, paths: Paths) -> list[tuple[int, str, int]]:
    """(path, text, signs of it in links) of each block with text that is a candidate, in page order."""
    out: list[tuple[int, str, int]] = []
    held = Open(paths)
    stack = held.stack
    parts: list[str] = []
    links = held.places["a"]
    linked = 0
    at, size, lower = 0, len(page), None

    def emit() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append((held.state[0], text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if held.state[1]:
            parts.append(html.unescape(text))
            if links:
                linked += len(_SPACE.sub(" ", parts[-1]).strip())

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end() if m.end() > m.start() else m.start() + 1
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            index = held.last({tag})
            if index < 0:
                if tag == "p":
                    emit()
                continue
            if tag not in BLOCK and held.blocks_from(index):
                if stack[index][1]:  # an inline end tag does not end the blocks within, but shows them again
                    held.cut(index, stack[index + 1 :])
                continue
            if held.blocks_from(index):
                emit()
            held.cut(index)
            continue
        if tag in VOID:
            if tag == "hr":
                emit()
            elif tag in ("br", "wbr", "img"):
                parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            emit()
        if tag in CLOSES_P:
            index = held.last({"p"})
            if index >= 0:
                held.cut(index, [x for x in stack[index + 1 :] if x[0] not in BLOCK and not x[1]])
        if tag in CLOSES:
            index = held.last(*CLOSES[tag])
            if index >= 0:
                held.cut(index)
        inside = bool(held.places["article"] or held.places["main"])
        unwanted, named = _judge(tag, m[3], inside)
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at) if len(lower) == size else re.compile(f"</{tag}", re.I).search(page, at)
            if not isinstance(end, int):
                end = end.start() if end else -1
            at = size if end < 0 else end
        if m[3].rstrip().endswith("/") and tag in ("svg", "path", "math"):
            continue
        label = ""
        if tag in BLOCK:
            own = _CLASS.search(m[3]) if m[3] else None
            label = (f"{tag}.{own[1]}" if own else tag) + "!" * named
        held.push(tag, unwanted, label)
    emit()
    return out


def fused_ratios(found: list[tuple[int, str, int]], paths: Paths) -> dict[int, float]:
    """The smoothed and fused ratio of each path that has blocks."""
    sums: dict[int, list[int]] = {}
    for path, text, linked in found:
        s = sums.setdefault(path, [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(text) - linked
        s[2] += len(_MARKS.findall(text))
        s[3] += len(text)
    inside: dict[int, list[int]] = {}  # of a container: blocks, length and punctuation of the paths right below
    for path, (n, length, marks, _) in sums.items():
        c = inside.setdefault(paths.above[path], [0, 0, 0])
        if not paths.named[path]:
            c[0], c[1], c[2] = c[0] + n, c[1] + length, c[2] + marks
    page = max(1, sum(length for _, length, _ in inside.values()))
    around = [(0.0, 0.0, 0.0)] * len(paths.above)  # what a path gets from its containers, and their share of the page's text
    for p in range(1, len(around)):  # a path comes after the one above it
        up = paths.above[p]
        n, length, marks = inside.get(up, (0, 0, 0))
        further = tuple(x * DECAY for x in around[up])
        around[p] = tuple(map(max, further, (length / n, marks / n, length / page))) if n else further
    fused = {}
    for p, (n, length, marks, whole) in sums.items():
        a, b = (OWN * own / n + (1 - OWN) * near for own, near in zip((length, marks), around[p], strict=False))
        share = max(around[p][2], length / page)
        fused[p] = a * math.log(2 + b) * share * (length / whole) * (NAMED if paths.named[p] else 1)
    # A heading speaks for what follows it.
    follow: dict[int, list[float]] = {}
    ahead, named = 0.0, False
    for path, _, _ in reversed(found):
        if paths.step[path][:2] in HEADINGS:
            follow.setdefault(path, []).append(ahead * (NAMED if paths.named[path] and not named else 1))
        else:
            ahead, named = fused[path], paths.named[path]
    return fused | {p: AHEAD * sum(x) / len(x) for p, x in follow.items()}


def content_paths(found: list[tuple[int, str, int]], paths: Paths) -> set[int]:
    """The paths whose fused ratios reach the threshold."""
    fused = fused_ratios(found, paths)
    least = LEAST * max(fused.values(), default=0.0)
    return {p for p, x in fused.items() if x >= (max(least, NAMED_LEAST) if paths.named[p] else least)}


def main_text(page: str) -> str:
    paths = Paths()
    found = blocks(page, paths)
    content = content_paths(found, paths)
    return "\n".join(text for path, text, _ in found if path in content)


def extract(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of each page."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for batch in slices(whole, page, SLICE):
                yield batch, [pa.array([main_text(p) for p in texts(batch, page)], pa.string())]

    return append_columns(df, [T.StructField(out, T.StringType())], make)
