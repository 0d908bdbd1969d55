"""Alignment against a plain version: whole texts through the libraries, offsets in sets, all pairs of a group."""

import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docquarry.llm import alignment
from docquarry.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, slice long, pair int, `count` string, n_a double"


def plain(docs):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {x: n for n, x in enumerate(byte_letters())}
    letters = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    aligned, held = [], collections.Counter()
    for i, text in docs:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        said_a, said_b = [letters[x] for x in ids_a], [piece(x) for x in ids_b]
        if not text or b"".join(said_a) != (" " + text).encode() or b"".join(said_b) != (" " + text).encode():
            aligned.append((i, [], [], []))
            continue
        ends = []
        for said in (said_a, said_b):
            at, found = 0, []
            for x in said:
                at += len(x)
                found.append(at)
            ends.append(found)
        groups, p, q = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            n, m = ends[0].index(cut, p) + 1, ends[1].index(cut, q) + 1
            groups.append((ids_a[p:n], ids_b[q:m]))
            p, q = n, m
        aligned.append((i, ids_a, ids_b, groups))
        held.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    rows = []
    for i, ids_a, ids_b, groups in aligned:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        sha = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        rows.append((i, len(ids_a), len(ids_b), len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), sha))
    return rows


def test_the_whole_table(spark):
    import __spark_entry__

    at = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    got = __spark_entry__.queries()["op11_alignment"](spark, at).collect()
    assert sorted(map(tuple, got)) == sorted(plain(docs))


ODD = [
    "", " ", "  two  spaces  ", " lead", "trail ", "a\nb\n\nc\td", "x \n y", "é漢字 😀👍🏽", "<|endoftext|> is <s> text </s>", "<0x0A> <unk>", "▁ is not a space ▁a", "a\x00b \x07", "ﬁ Å Ａ \xa0 　x",
    "    def f(x):\n        return x\n", "don't we'll I'd", "1234567 3.14 ٣", "a\r\nb", " x  ", "\x85 y\x85z", "\x1c a \x1d", "aaaaaaaa " * 30, "…—“quoted”", "ünï " * 40,
]


@pytest.mark.parametrize("size", [1, 200, 8 << 20])
def test_odd_texts_in_slices_of_any_size(spark, size):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (100, None), (7, ODD[7]), (7, ODD[7])]
    docs = spark.createDataFrame([(i, t, 1, 2, "c", 0.5) for i, t in rows], SCHEMA)
    got = alignment.align(docs, A, B, size=size).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain(rows))
    assert alignment.align(docs.limit(0), A, B).count() == 0
    zeros = alignment.align(docs.where("text is null or text = ''"), A, B, size=size).collect()
    assert {tuple(r)[1:] for r in zeros} == {(0, 0, 0, 0, 0, 0, "")}


def test_long_texts_and_long_groups():
    aligner = alignment.Aligner(A, B)
    for text in ("many words stand here " * 20_000, "ab" * 20_000, "漢字" * 5000, " " * 3000 + "x", "a\n" * 5000):
        x = aligner.slice([text, "many words"])
        [(_, n_a, n_b, n_groups, n_links, _, _, sha), _] = plain([(0, text), (1, "many words")])
        assert (x["n_a"][0], x["n_b"][0], x["n_groups"][0], x["groups_sha256"][0]) == (n_a, n_b, n_groups, sha)
        assert x["links"][: x["offsets"][1]].sum() == n_links


def test_chunks_without_white_space_are_encoded_in_one_call():
    aligner = alignment.Aligner(A, B)
    calls, encode = [], aligner.fast.encode_ordinary

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return encode(text)

    aligner.fast = Counted()
    texts = ["some words, don't 3.14 stand here", "here\nstand words", "x \n y", "漢字 words", "…", " lead", "a\x00b <|endoftext|> é", ""]
    x = aligner.slice(texts)
    assert [len(c.split()) for c in calls if not set("\n\t") & set(c)][0] > 5 and len(calls) <= 5
    for i, row in enumerate(plain(list(enumerate(texts)))):
        assert (x["n_a"][i], x["n_b"][i], x["n_groups"][i], x["groups_sha256"][i]) == (*row[1:4], row[7])
        assert x["links"][x["offsets"][i] : x["offsets"][i + 1]].sum() == row[4]
