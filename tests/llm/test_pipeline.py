"""All stages of the corpus pipeline, and the whole of it, against slow versions on a small table."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from docquarry.llm import lines, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_chars long, hits long, n_removed long, `rest.kept` string, score double, kept_0 string"


def slow_toxic(rows, lexicon):
    automaton = lexicon.automaton()
    half = lexicon.cutoff * (1 - toxicity.CUTOFF_SCORE) / toxicity.CUTOFF_SCORE
    out = []
    for r in rows:
        folded = toxicity.fold(r["text"] or "")
        z = toxicity.normalised(toxicity.matched(automaton, folded)[0], folded)
        if z / (z + half) < toxicity.CUTOFF_SCORE:
            out.append(r)
    return out


def slow_lines(rows):
    pages, seen = defaultdict(set), defaultdict(set)
    for r in rows:
        pages[r["source"]].add(r["text"])
        for line in set((r["text"] or "").split("\n")) if r["text"] is not None else ():
            seen[r["source"], line].add(r["text"])
    bad = {k for k, v in seen.items() if k[1].strip(" \t\r") and len(v) >= lines.MIN_PAGES and len(v) > lines.RATIO * len(pages[k[0]])}
    return [r if r["text"] is None else {**r, "text": "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in bad)} for r in rows]


def slow_groups(rows):
    prints = [simhash.fingerprint((r["text"] or "").encode()) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def slow_passages(rows):
    words = [[m.span() for m in WORD.finditer(r["text"] or "")] for r in rows]
    windows = Counter()
    each = [[" ".join(r["text"][a:b] for a, b in w[i : i + 35]) for i in range(len(w) - 34)] for r, w in zip(rows, words, strict=True)]
    for x in each:
        windows.update(x)
    out = []
    for r, w, x in zip(rows, words, each, strict=True):
        gone = {i + k for i, t in enumerate(x) if windows[t] > 1 for k in range(35)}
        text, at = "", 0
        for i, (a, b) in enumerate(w):
            if i in gone:
                text += r["text"][at:a] if i - 1 not in gone else ""
                at = b
        out.append({**r, "text": text + r["text"][at:] if gone else r["text"], "left": [r["text"][a:b] for i, (a, b) in enumerate(w) if i not in gone]})
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"{rng.choice('bcdfgk')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{i}" for i in range(900)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = some(60)
    texts = []
    for i in range(120):
        text = "\n".join(some(rng.randint(5, 20)) for _ in range(rng.randint(2, 5)))
        if i % 12 == 0:
            text = f"All rights are kept\n{text}"
        if i % 15 == 1:
            text += f"\n{passage}\nend{i} and so on"
        if i % 6 == 2:
            text += " you are a wretched blockhead and a wretched fool"
        texts.append(text)
    texts += [texts[3]] * 7 + [texts[5] + " x", None, None, "", " \n", "one", "One", some(4000), "\n\n"]
    rows = [(None if i in (20, 131) else i, t, None if i % 17 == 0 else "ab"[i % 2], 1, 77, 78, f"r{i}", 0.5, f"k{i}") for i, t in enumerate(texts)]
    rows += rows[30:32]  # whole rows that repeat
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 2)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def plain(df):
    return [r.asDict() for r in df.collect()]


def key(r):
    return tuple("" if r[c] is None else str(r[c]) for c in ("rest.kept", "text", "doc_id"))


def same(got, want):
    columns = ["doc_id", "text", "source", "hits", "n_removed", "rest.kept", "score", "kept_0"]
    pick = lambda rows: sorted([{c: r[c] for c in columns} for r in rows], key=key)
    assert pick(got) == pick(want)
    for r in got:
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"])) or r["n_chars"] == 1


def test_stages_match_slow_versions(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = plain(docs)
    for i, (name, stage) in enumerate(P.STAGES[:4]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        got = plain(docs)
        if name == "toxicity":
            want = slow_toxic(rows, lexicon)
            assert 10 <= len(rows) - len(want) <= 30
        elif name == "line_dedup":
            want = slow_lines(rows)
            assert any(a["text"] != b["text"] for a, b in zip(rows, want, strict=True))
        elif name == "simhash_near_dedup":
            groups = defaultdict(list)
            for g, r in zip(slow_groups(rows), rows, strict=True):
                groups[g].append(r)
            assert len(got) == len(groups) < len(rows)
            for g in groups.values():
                ids = [r["doc_id"] for r in g if r["doc_id"] is not None]
                stayed = [r for r in got if any(r["rest.kept"] == x["rest.kept"] for x in g)]
                assert len(stayed) == 1
                assert stayed[0]["doc_id"] == (min(ids) if ids else None)
            want = got
        else:
            want = slow_passages(rows)
            assert sum(a["text"] != b["text"] for a, b in zip(rows, want, strict=True)) > 3
            assert any(re.search(r"\nend\d+ and so on", r["text"]) for r in got if r["text"])
            assert sorted(WORD.findall(r["text"] or "") for r in got) == sorted(r["left"] for r in want)
        same(got, want)
        rows = got
    pieces = plain(P.pack(spark, docs, folder))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], *[*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in rows)
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert (p["length"], p["ids_crc32"]) == (len(ids), zlib.crc32(p["ids"]))
        by_doc[p["doc_id"]].append((p["start"], ids))
        sequences[p["sequence_id"]].append((p["offset"], len(ids)))
    assert Counter((d, *[x for _, ids in sorted(ps) for x in ids]) for d, ps in by_doc.items() if d is not None) == Counter({k: n for k, n in want.items() if k[0] is not None})
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024


def test_the_whole_run(spark, folder):
    got = plain(P.run(spark, folder))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, folder)
    want = plain(P.pack(spark, docs, folder))
    total = lambda rows: Counter((r["doc_id"], r["start"] == 0, r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert total(got) == total(want)


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert out.count() == 0
    assert P.pack(spark, docs, folder).count() == 0
