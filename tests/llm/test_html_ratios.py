"""Tag-path ratios decide: against a slow version, and without any class names on the pages."""

import math
import random
import re

import pytest

from docquarry.llm import html_text

AT = "/root/testdata/sf0.01/pages.parquet"


def slow_ratios(found, paths):
    """The ratios by their definition, each path's containers looked up one by one."""

    def chain(p):
        return [] if p <= 0 else [*chain(paths.above[p]), p]

    def mean(blocks):
        return (sum(len(t) - k for t, k in blocks) / len(blocks), sum(len(html_text._MARKS.findall(t)) for t, _ in blocks) / len(blocks), sum(len(t) - k for t, k in blocks))

    used = list(dict.fromkeys(p for p, _, _ in found))
    blocks_of = {p: [(t, k) for q, t, k in found if q == p] for p in used}
    page = max(1, sum(mean(blocks_of[p])[2] for p in used if not paths.named[p]))
    fused = {}
    for p in used:
        length, marks, total = mean(blocks_of[p])
        near = [0.0, 0.0, 0.0]
        for distance, c in enumerate(reversed([0, *chain(p)[:-1]])):
            direct = [x for q in used if paths.above[q] == c and not paths.named[q] for x in blocks_of[q]]
            if direct:
                a, b, n = mean(direct)
                near = [max(x, y * html_text.DECAY**distance) for x, y in zip(near, (a, b, n / page), strict=True)]
        a, b = html_text.OWN * length + (1 - html_text.OWN) * near[0], html_text.OWN * marks + (1 - html_text.OWN) * near[1]
        plain = total / sum(len(t) for t, _ in blocks_of[p])
        fused[p] = a * math.log(2 + b) * max(near[2], total / page) * plain * (html_text.NAMED if paths.named[p] else 1)
    out = dict(fused)
    for p in used:
        if paths.step[p][:2] in html_text.HEADINGS:
            after = []
            for i, (q, _, _) in enumerate(found):
                if q == p:
                    after.append(next((fused[r] * (html_text.NAMED if paths.named[p] and not paths.named[r] else 1) for r, _, _ in found[i + 1 :] if paths.step[r][:2] not in html_text.HEADINGS), 0.0))
            out[p] = html_text.AHEAD * sum(after) / len(after)
    return out


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n)).capitalize() + rng.choice(".!?")


def page(rng, names=True):
    """An article among other things, and its text."""
    c = lambda x: f' class="{x}"' if names else ""
    want = [sentence(rng, 6)[:-1]]
    body = f"<h1>{want[0]}</h1>"
    for _ in range(rng.randint(4, 8)):
        said = " ".join(sentence(rng, rng.randint(5, 18)) for _ in range(rng.randint(2, 6)))
        k = rng.random()
        if k < 0.85:
            want.append(said)
            body += f"<p>{said}</p>"
        else:
            heads = [sentence(rng, 4)[:-1], said]
            want += heads
            body += f"<h2>{heads[0]}</h2><p>{heads[1]}</p>"
    related = f"<div{c('related')}><h3>More</h3><ul>" + "".join(f'<li><a href="/x">{sentence(rng, 5)}</a></li>' for _ in range(4)) + "</ul></div>"
    around = f"<header><h2>Site</h2></header><nav><a href=/>Home</a></nav><div{c('cookie-notice')}>We use cookies.</div><div{c('ad')}>{sentence(rng, 5)}</div>"
    side = f"<div{c('sidebar')}><ul>" + "".join(f'<li><a href="/y">{sentence(rng, 6)}</a></li>' for _ in range(5)) + "</ul></div>"
    comments = f"<section{c('comments')}>" + "".join(f"<div{c('comment')}><p>{sentence(rng, 8)}</p></div>" for _ in range(3)) + "</section>" if names else ""
    return f"<html><body>{around}<div{c('wrap')}><article>{body}{related}{comments}</article>{side}</div><footer>f</footer></body></html>", "\n".join(want)


@pytest.mark.parametrize("names", [True, False])
def test_articles_among_other_things(names):
    rng = random.Random(3)
    for _ in range(100):
        made, want = page(rng, names)
        assert html_text.main_text(made) == want


def test_ratios_against_a_slow_version():
    rng = random.Random(4)
    pages = [page(rng, i % 2 == 0)[0] for i in range(30)] + ["", "<p>a", "<div><h1>x</h1><div><h2>y</h2><p>z, z.</p></div></div>", "<h1>only</h1>", "<a href=x>link</a><p>text <a>link.</a></p>"]
    for made in pages:
        paths = html_text.Paths()
        found = html_text.blocks(made, paths)
        got, want = html_text.fused_ratios(found, paths), slow_ratios(found, paths)
        assert got.keys() == want.keys()
        for p in got:
            assert got[p] == pytest.approx(want[p], rel=1e-9, abs=1e-12)


def test_pages_without_their_class_names(spark):
    """The names are one factor: nearly all pages of the table give the same text without them, and there the ratios drop what they do not say."""
    same = decided = n = 0
    for r in spark.read.parquet(AT).collect():
        whole = html_text.main_text(r.html)
        bare = re.sub(r' class="[^"]*"', "", r.html)
        text = html_text.main_text(bare)
        n += 1
        same += text == whole
        decided += text != "\n".join(t for _, t, _ in html_text.blocks(bare, html_text.Paths()))
    assert same >= 0.93 * n
    assert decided >= 0.93 * n


def test_text_that_browsers_show_is_a_candidate():
    said = "A sentence of some length, with a comma; and it goes on for a while, as sentences do."
    for tag in ("object", "video", "audio", "canvas", "math"):
        assert html_text.main_text(f"<article><p>{said}</p><p>In <{tag}>{tag} text</{tag}> too.</p></article>") == f"{said}\nIn {tag} text too."
