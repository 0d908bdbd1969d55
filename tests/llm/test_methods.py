"""Each operator against a slow version of its definition, or an exact round trip."""

import collections
import time
import hashlib
import math
import random
import re
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docquarry.llm import bpe, cws, html_text, lines, maxent, packing, substring, topk, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = "abcdefgh'sS <|endoftext|> ÀéΣςΑİıßﬁ́  \t\n\x1c\x85 12٣Ⅷ!?# 漢字 😀👍🏽   "


def some_texts(rng, n):
    for i in range(n):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40)))
        yield text + ("<|endoftext|>" + text[:5]) * (i % 5 == 0) + text * (300 * (i % 50 == 0))


def test_segment_tree_gives_the_library_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    mine, theirs = bpe.SegmentTreeBpe(path), Tokenizer.from_file(path)
    for text in some_texts(random.Random(1), 1500):
        want = theirs.encode(text, add_special_tokens=False).ids
        got = b"".join(mine.encode_chunks(text.split(" ")))
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)
        assert mine.decode(got) == theirs.decode(want, skip_special_tokens=False)


def test_every_code_point_alone_and_within_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    mine, theirs = bpe.SegmentTreeBpe(path), Tokenizer.from_file(path)
    points = [*range(0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE0200)]
    for make in (chr, lambda c: f"ab{chr(c)}C"):
        for at in range(0, len(points), 20_000):
            texts = [make(c) for c in points[at : at + 20_000]]
            want = theirs.encode_batch(texts, add_special_tokens=False)
            got = mine.encode_chunks([t for t in texts if " " not in t])
            for g, w in zip(got, [w for t, w in zip(texts, want, strict=True) if " " not in t], strict=True):
                assert np.frombuffer(g, "<u4").tolist() == w.ids


def test_long_words_have_a_tree_of_their_own():
    path = public_tokenizers.path("word_bpe_49k.json")
    mine, theirs = bpe.SegmentTreeBpe(path), Tokenizer.from_file(path)
    rng = random.Random(12)
    for n in (bpe.LONG, bpe.LONG + 1, 5000, 40_000):
        for letters in ("a", "ab", "theandingof", "éa漢"):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert np.frombuffer(mine.encode_chunks([word])[0], "<u4").tolist() == theirs.encode(word, add_special_tokens=False).ids
    start = time.process_time()
    mine.encode_chunks(["".join(rng.choice("abcdefgh") for _ in range(200_000))])
    assert time.process_time() - start < 20


def _whole(spark, name):
    import __spark_entry__

    at = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()}
    return docs, __spark_entry__.queries()[name](spark, at).collect()


def test_op1_hashes_on_the_whole_table(spark):
    docs, rows = _whole(spark, "op1_bpe")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_op6_pieces_on_the_whole_table(spark):
    docs, rows = _whole(spark, "op6_packing")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in docs.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (len(part), zlib.crc32(part.tobytes()), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts, total in [(sorted(p), len(ids[i])) for i, p in pieces.items()] + [(sorted(p), None) for p in sequences.values()]:
        at = 0
        for start, length in parts:
            assert start == at
            at += length
        assert at == total or (total is None and at <= 1024)
    assert set(pieces) == set(ids)
    assert sum(map(len, ids.values())) > 0.97 * 1024 * (len(sequences) - 1)


def test_op8_likeness_on_the_whole_table(spark):
    """near_next and near_edited are the shares of equal samples, and near the likeness of the weighted words."""
    docs, rows = _whole(spark, "op8_fingerprints")
    order = sorted(docs)
    after = {a: b for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    prints = {r.doc_id: r.fingerprint for r in rows}
    for r in rows:
        half = len(docs[r.doc_id]) // 2
        edited = docs[r.doc_id][: len(docs[r.doc_id]) - half] + docs[after[r.doc_id]][:half]
        assert (r.n_chars, r.edited_sha256) == (len(docs[r.doc_id]), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1
        assert (r.near_next == 1) >= (prints[after[r.doc_id]] == r.fingerprint)
        if edited == docs[r.doc_id]:
            assert r.near_edited == 1
        if docs[after[r.doc_id]] == docs[r.doc_id]:
            assert r.near_next == 1


def test_byte_ids_are_the_library_ids():
    mine = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    for text in some_texts(random.Random(2), 1500):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == mine.exact.encode(text, add_special_tokens=False).ids, repr(text)


def test_byte_ids_of_a_column_look_each_chunk_up_once():
    """The ids are the library's beside every kind of space, and equal chunks of all texts are encoded in one call."""
    mine = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    parts = ["a", "Z", "é", "ɐ", "漢", "12", " ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", "'s", "!", "<|endoftext|>", " a", " b", "\n ", "\0", *mine.special]
    texts = [None, "", " ", "a ", "\n", "b\n", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000))]
    for text, ids in zip(texts, mine.encode_all(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == mine.exact.encode(text or "", add_special_tokens=False).ids, repr(text)
    mine.memo.clear()
    calls, encode = [], mine.fast.encode_ordinary
    mine.fast.encode_ordinary = lambda x: calls.append(x) or encode(x)
    mine.encode_all(pa.array(["one two three two", "one three four", "one"]))
    assert calls.count("one") == 3 and len(calls) == 4  # first chunks have no space before them
    assert sorted(c for x in calls if x != "one" for c in x.split()) == ["four", "one", "three", "two"]


def test_packing_covers_every_token_without_padding():
    rng = random.Random(3)
    for n in (0, 1, 3, 500):
        lengths = [rng.choice([1, 5, rng.randint(1, 3000), 1024, 1023]) for _ in range(n)]
        pieces = packing.pack(lengths, 1024, 1.0, 1 / 1024)
        docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
        for d, start, length, s, offset in pieces:
            docs[d].append((start, length))
            sequences[s].append((offset, length))
        assert len(docs) == n
        for parts, total in [(sorted(docs[d]), lengths[d]) for d in docs] + [(sorted(x), None) for x in sequences.values()]:
            at = 0
            for start, length in parts:
                assert (start, length > 0) == (at, True)
                at += length
            assert at == total or total is None and (at == 1024 or at & (at - 1) == 0)
        whole = [x for x in sequences.values() if sum(b for _, b in x) == 1024 and len(x) > 1]
        costs = [sum(b + b * b / 1024 for _, b in x) for x in whole]
        assert not costs or max(costs) < 2.5 * min(costs)


def test_packing_forgets_its_chunks_at_the_end_of_a_task(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, f"some words of {i}") for i in range(50)], "doc_id long, text string").coalesce(1)

    def after(batches):
        for batch in batches:
            rows = batch.num_rows
        yield pa.record_batch([pa.array([rows]), pa.array([len(packing.loaded(path).memo)])], names=["pieces", "kept"])

    assert packing.pack_documents(docs, path).count() >= 50
    assert spark.range(1).coalesce(1).mapInArrow(after, "pieces long, kept long").first().kept == 0


def test_packed_ids_join_to_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = collections.defaultdict(list)
    for r in packing.pack_documents(docs, path, window=20_000).collect():
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
    exact = Tokenizer.from_file(path)
    for r in docs.limit(60).collect():
        ids = b"".join(x for _, x in sorted(pieces[r.doc_id]))
        assert np.frombuffer(ids, "<u4").tolist() == [*exact.encode(r.text or "", add_special_tokens=False).ids, 0]


def slow_removal(texts, window):
    words = [WORDS.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_substring_removal_matches_all_windows(spark):
    rng = random.Random(4)
    passage = [" ".join(rng.choice("abcdefghij") for _ in range(60)) for _ in range(6)]
    texts = []
    for i in range(120):
        own = " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 60)))
        texts.append(rng.choice(["", own, f"{own} {rng.choice(passage)}\n{own[:20]}", rng.choice(passage), "x " * 90, rng.choice(passage)[10:70] + "\t" + own, "a b " * 40]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for window, gram in ((35, 4), (6, 2), (3, 1)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove(docs, window=window, gram=gram, buckets=7).collect()}
        assert [got[i] for i in range(len(texts))] == slow_removal(texts, window), window


def test_hot_minimiser_is_split_below_the_bound(spark):
    """A phrase between differing words everywhere: one source's windows share a minimiser."""
    rng = random.Random(9)
    lines_ = [" ".join(f"v{rng.randrange(30)}" for _ in range(3)) for _ in range(50)]
    texts = [" ".join(f"at level info {rng.choice(lines_)} w{rng.randrange(400)}" for _ in range(rng.randint(5, 30))) for _ in range(150)]
    texts += texts[:5] + ["", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    window, gram, bound = 12, 3, 20_000
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove(docs, window=window, gram=gram, bound=bound).collect()}
    assert [got[i] for i in range(len(texts))] == slow_removal(texts, window)
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("fp"), "text")
    base, spread = substring.plan(rows, window, gram, 64, bound)
    assert spread.max() > 1
    held = collections.Counter()
    for r in substring._split(rows, window, gram, base, spread).collect():
        raw = zstandard.ZstdDecompressor().decompress(bytes(r.blob))
        n, once, more = struct.unpack_from("<III", raw)
        held[r.bucket] += len(raw) - 12 - 5 * n - substring.KEY_SIZE * (once + more)
    assert max(held.values()) <= bound


def test_a_batch_is_looked_at_in_little_memory(monkeypatch):
    rng = random.Random(5)
    rows = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(1500)) for _ in range(800)]
    batch = pa.record_batch([pa.array(range(800)), pa.array(range(800)), pa.array(rows)], names=["id", "fp", "text"])

    class Rows:
        """A table whose only task runs here."""

        def mapInArrow(self, run, schema):
            self.found = run(iter([batch]))
            return self

        groupBy = agg = lambda self, *columns: self

    monkeypatch.setattr(substring, "F", type("Functions", (), {"sum": staticmethod(lambda name: F.lit(name))}))
    task = Rows()
    substring._measured(task, 35, 4, 1024)
    tracemalloc.start()
    whole = sum(sum(x.column(1).to_pylist()) for x in task.found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert whole > batch.nbytes > 7_000_000
    assert peak < 64 << 20


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring, "window_hashes", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    strings = [b"a b c d", b"b c x y", b"p q r", b"p q r"]
    got = substring.repeated_windows(strings, np.array([3, 3, 2, 2]), np.zeros(4, bool), 2)
    assert got.tolist() == [False, True, False, True, False, False, True, True, True, True]


def test_toxic_lexicon_on_held_out_rows(spark):
    import __spark_entry__

    at = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [r for r in __spark_entry__.queries()["op2_toxicity"](spark, at).collect()]
    assert len(rows) == spark.read.parquet(f"{at}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    seen = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    hit, wrong, lost = (sum(p == a and y == b for p, y in seen) for a, b in ((1, 1), (1, 0), (0, 1)))
    assert hit / (hit + wrong) > 0.95
    assert hit / (hit + lost) > 0.85


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " mor": 2.0, " trash ": 2.0}, cutoff=1.0)
    automaton = lexicon.automaton()
    count = lambda t: toxicity.matched(automaton, toxicity.fold(t))[1]
    assert [count(t) for t in ("You IDIOT!", "1d10t", "іdіоt", "id​iot", "idiotic", "m0ron moron", "the!!! to$$$", "trash", "the trash can", "")] == [1, 1, 1, 1, 0, 2, 0, 1, 0, 0]


def test_line_frequencies(spark):
    rows = [(i, "h", f"own {i}\nshared\n" + ("rare" if i < 2 else "")) for i in range(40)] + [(100 + i, "other", "shared\nown") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in lines.remove_boilerplate(docs, ratio=0.5, min_pages=4).collect()}
    assert got == {i: t.replace("\nshared", "") if h == "h" else t for i, h, t in rows}


def test_copied_document_is_no_boilerplate_in_the_pipeline(spark):
    import corpus_pipeline

    copied = "a clean text\nof two lines"
    rows = [(i, "h", copied + "\nfooter" * (i >= 3), 0) for i in range(6)] + [(10 + i, "h", f"own {i}\nfooter", 0) for i in range(74)] + [(100, None, None, 0), (101, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()}
    want = {i: None if t is None else t.replace("\nfooter", "") for i, h, t, n in rows}
    assert got == {i: (t, None if t is None else len(t)) for i, t in want.items()}
    # op5 counts every row as a page, as its SQL does
    assert {r.text for r in lines.remove_boilerplate(docs).where("doc_id < 6").collect()} == {""}


def jaccard(a, b):
    keys = {*a, *b}
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def test_collisions_estimate_generalised_jaccard(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "be", "gamma", "delta", "epsilon", "z"]) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    weight = [{w: n * len(w) ** 2 for w, n in collections.Counter(t.split()).items()} for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    n = 64
    sig = {r.k: r.signature for r in cws.signatures(cws.weighted_terms(df, ["k"]), ["k"], n).collect()}
    off = [sum(a == b for a, b in zip(sig[i], sig[j], strict=True)) / n - jaccard(weight[i], weight[j]) for i in range(40) for j in range(i)]
    assert abs(np.mean(off)) < 0.03
    assert np.sqrt(np.mean(np.square(off))) < 0.09


def test_language_model_scores(spark):
    import __spark_entry__

    at = "/root/testdata/sf0.1"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()}
    tokens = {i: [*t.encode().lower().split(), b" "] for i, t in docs.items()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    c = collections.Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    total, kinds = sum(c.values()), len(c)
    rows = __spark_entry__.queries()["op9_lm"](spark, at).collect()
    assert len(rows) == len(docs)
    base = model = 0.0
    for r in rows:
        ws = tokens[r.doc_id]
        want = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), total)
        assert abs(r.base_score - want) < 1e-6 * max(1, -want)
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    assert model > 0.85 * base  # 0.82 when written


def test_language_model_probabilities_add_up(spark):
    """Over all words of training, the end, and the one token for unseen words, in several contexts."""
    rng = random.Random(7)
    words = ["aa", "bb", "cc", "dd", "ee", "ff"] + [f"rare{i}" for i in range(300)] + [f"{x}{y}ing" for x in "abcdefgh" for y in "xyz"]
    texts = [" ".join(rng.choice(words[:6]) if rng.random() < 0.6 else rng.choice(words) for _ in range(12)) for _ in range(80)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").withColumn("out", maxent.held_out("id"))
    chunks = maxent.stored(maxent.coded(rows))
    counts = maxent.stored(maxent.counted(chunks))
    want = collections.Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*t.encode().split(), maxent.END])
    got = {r.word.encode(): r.c for r in counts.where("first and c > 0").collect()}
    assert got == want
    model = maxent.fit(maxent.stored(maxent.with_counts(chunks, counts)), counts)
    assert any(abs(w).max() > 0 for w in model.weights)
    seen = sorted(set(want) - {maxent.END})
    listed = [*seen, b"never-seen", maxent.END]
    seen_by = np.array([want.get(w, 0) for w in listed])
    for before in ([], ["aa"], ["rare1", "bb"], ["never-seen", "cc", "dd"], ["ee", "ff", "aa", "bb"]):
        lead = [listed.index(w.encode()) for w in before]
        codes = np.array([x for w in range(len(listed)) for x in ([*lead, w] if listed[w] == maxent.END else [*lead, w, len(listed) - 1])])
        sizes = np.array([len(lead) + 1 + (w != maxent.END) for w in listed])
        chunk = maxent.Chunk(listed, seen_by, codes, sizes, np.zeros(len(sizes), bool))
        p = 10 ** model.log10(chunk)[np.cumsum(sizes) - sizes + len(lead)]
        assert abs(p.sum() - 1) < 1e-6
        assert (p > 0).all()


def test_language_model_describes_each_word_once(spark):
    """Chunks have what the classes say of their words, by one look at each word of the corpus; long words by their digest."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["ä" * 400 + "x", "ä" * 400 + "y"]
    texts = [" ".join(rng.choice(words) for _ in range(9)) for _ in range(60)] + [None, "only-" + "z" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("out", maxent.held_out("id")).repartition(4)
    chunks = maxent.stored(maxent.coded(rows))
    assert chunks.count() == 4 and max(len(w) for r in chunks.collect() for w in r.words.split(maxent.BREAK)) <= 4 * maxent.LONGEST
    counts = maxent.stored(maxent.counted(chunks))
    want = collections.Counter(maxent.brief(w) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*(t or "").encode().split(), maxent.END])
    model, ready = maxent.fitted(chunks, counts)
    firsts = collections.Counter()
    for r in ready.collect():
        own = bytes(r.words).split(maxent.BREAK)
        about, c = maxent._unplaned(bytes(r.about), "<i8"), maxent._unplaned(bytes(r.counts), "<i8")
        assert c.tolist() == [want.get(w, 0) for w in own]
        assert (about & (1 << 48) - 1).tolist() == model.classes.about(own, c).tolist()
        firsts.update(w for w, x in zip(own, about >> 48, strict=True) if x)
    assert set(want) <= set(firsts) and set(firsts.values()) == {1}
    assert sum(w.startswith("ä".encode()) for w in firsts) == 2


def test_language_model_tree_sums_all_parts(spark):
    rows = [(t, 0, b, np.full(4, t + b, "<f4").tobytes(), np.full(2, t, "<i8").tobytes()) for t in range(70) for b in (0, 8)]
    got = {r.block: r for r in maxent._summed(spark.createDataFrame(rows, maxent._PARTS).repartition(5), 70).collect()}
    assert len(got) == 2
    for b in (0, 8):
        assert np.frombuffer(got[b].moved, "<f4").tolist() == [sum(t + b for t in range(70))] * 4
        assert np.frombuffer(got[b].met, "<i8").tolist() == [sum(range(70))] * 2


def test_class_of_a_word_that_is_not_clustered_is_its_own():
    """It does not depend on the words that stand beside it in a dictionary."""
    rng = np.random.default_rng(5)
    table = rng.normal(size=(maxent.TRIGRAMS, 14)).astype(np.float32)
    words = [f"{a}{b}".encode() for a in ("q", "rare", "ünd", "x" * 70) for b in range(200)]
    alone = [int(maxent.rare_class([w], table)[0]) for w in words]
    assert maxent.rare_class(words, table).tolist() == alone
    assert maxent.rare_class(words[::-1], table).tolist() == alone[::-1]


def test_language_model_uses_words_in_context(spark):
    """Words that follow each other are likelier than their counts say, within a class too."""
    pairs = [(f"w{i}", f"v{i}") for i in range(8)]
    rng = random.Random(2)
    texts = [" ".join(x for _ in range(30) for x in rng.choice(pairs)) for _ in range(300)]
    rows = maxent.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()
    base, model = (sum(getattr(r, c) for r in rows if r.held_out) for c in ("base_score", "score"))
    assert model > 0.7 * base  # half of all words are certain


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[200:260] = x[0]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = []
    for i in range(0, 400, 20):
        s = q @ q[i]
        best = sorted((-s[j], j) for j in range(400) if j != i)[:7]
        want += [(i, n + 1, j, -v) for n, (v, j) in enumerate(best)]
    for parts in (1, 2, 5):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, every=20, k=7, parts=parts).collect())
        assert got == sorted(want)


def test_top_k_over_many_blocks(spark, monkeypatch):
    """Several groups of blocks and of queries, a block of equal vectors among them, ids that repeat, and vectors of unequal length."""
    for name, n in (("BLOCK", 16), ("QUERIES", 4), ("GROUP", 2), ("SUB", 3)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(9)
    x = [rng.normal(size=rng.choice([7, 8])).tolist() for _ in range(300)]
    x[100:180] = [x[3]] * 80
    ids = [i if i < 290 else i - 5 for i in range(300)]
    df = spark.createDataFrame(list(zip(ids, x, strict=True)), "vec_id long, embedding array<double>").repartition(4, "vec_id")
    q = np.array([[math.floor(256 * y) for y in v] + [0] * (8 - len(v)) for v in x])
    want = []
    for i in range(0, 291, 10):
        best = {}
        for j in range(300):
            if ids[j] != i:
                best[ids[j]] = max(best.get(ids[j], -(1 << 60)), int(q[j] @ q[ids.index(i)]))
        want += [(i, n + 1, j, s) for n, (j, s) in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:5])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, every=10).collect())
    assert got == sorted(want)


def test_top_k_resolves_few_places():
    """With a cutoff, only places that some list returns are summed, and they hold the answer."""
    rng = np.random.default_rng(10)
    v = np.floor(256 * rng.normal(size=(4000, 64))).astype(np.int64)
    q, ids, q_ids = v[::80], np.arange(4000), np.arange(0, 4000, 80)
    scores = np.where(q_ids[:, None] == ids[None], np.iinfo(np.int64).min, q @ v.T)
    _, _, _, started = topk.meeting(q, v[:800], q_ids, ids[:800], None, 4, 5)
    sample = np.sort(scores[:, :800], axis=1)[:, -5].astype(float)
    a, b, s, resolved = topk.meeting(q, v, q_ids, ids, sample, 4, 5)
    assert started < 0.05 * len(q) * 800
    assert resolved < 0.5 * len(q) * 4000
    for i in range(len(q)):
        assert s[a == i].tolist() == np.sort(scores[i])[::-1][:5].tolist()


def test_article_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">ok?</div>
    <article><h1>Head &amp; line</h1><p><b>First   para<br>graph.<p>Second <a href=x>linked</a> one.</p><script>var t="</p>";</script><ul><li>one<li>two</ul>
    <div class="comments"><p>me too</p></div></article><aside>side</aside><form>f</form><footer>&copy; foot</footer>"""
    assert html_text.main_text(page) == "Head & line\nFirst para graph.\nSecond linked one.\none\ntwo"


def test_text_of_inline_elements_that_do_not_count_is_cut_out_of_its_block():
    page = "<article><p>Text <span class=ad>buy</span>stays <script>x</script>in <button>Share</button>one <b>block.</b></p><p>Next<a class='read-more' hidden>more</a>.</p></article>"
    assert html_text.main_text(page) == "Text stays in one block.\nNext."


def test_names_weigh_in_the_ratio():
    body = "".join(f"<p>Sentence number {i}, which is long enough to count, says this and that; it goes on for a while. {'More of it, too. ' * 12}</p>" for i in range(5))
    inside = f"<h1>Head</h1>{body}"
    said = html_text.main_text(f"<article>{inside}</article>")
    assert said.count("\n") == 5
    # an advert and comments lose against an article beside or around them
    assert html_text.main_text(f"<div class=ad>Buy this, now! {'And that, too. ' * 9}</div><article>{inside}<div class=comments><p>I, too, think so; it is good.</p></div></article>") == said
    # a page of nothing else has no text, unless it is long and dense as an article is
    assert html_text.main_text("<nav>Menu</nav><div class=ad>Buy this, now! It is good.</div><footer>f</footer>") == ""
    assert html_text.main_text(f"<div class=promo-page>{inside}</div>") == said
    # paths below the threshold go where no element says article
    assert html_text.main_text(f"<body><span>Home</span><table><tr><td>x<td>y</table><div>{inside}</div><dl><dt>a<dd>b</dl></body>") == said


def test_odd_pages_take_linear_time():
    start = time.process_time()
    assert html_text.main_text("<div>" * 8000 + "x" + "</div>" * 8000) == "x"
    assert html_text.main_text("".join(f"<div class=c{i}>text {i}, here.</div>" for i in range(20_000))).count("\n") > 1000
    assert html_text.main_text("<b>" * 5000 + "<div>x</b>" * 5000).count("x") == 5000
    assert time.process_time() - start < 15


def test_zero_width_space_is_no_white_space():
    assert html_text.main_text("<p>a\u200bb  c</p>") == "a\u200bb c"


def test_signs_at_the_end_of_a_word_are_read_both_ways():
    for text, word in (("what garbag3 it is", "garbage"), ("an A$$", "ass"), ("usele55.", "useless"), ("you idi07!", "idiot"), ("h4t3", "hate")):
        assert f" {word} " in toxicity.fold(text), text
    for text in ("the!!!", "covid19", "in 2024", "a b c"):
        assert toxicity.fold(text).split() == re.sub(r"\W+", " ", text).split()


def test_article_by_ratios():
    body = "".join(f"<p>Sentence number {i}, which is long enough to count, says this and that; it goes on for a while.</p>" for i in range(6))
    page = f"<body><div class='top'><span>Home</span> <span>News</span></div><div class='content with-sidebar'>{body}</div><table><tr><td>x</td><td>y</td></tr></table><div class='sidebar'>Buy, now!</div></body>"
    assert html_text.main_text(page).count("\n") == 5
    assert html_text.main_text(page).startswith("Sentence number 0, which")
