import random

import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from docquarry.llm import graph, simhash

SCHEMA = "doc_id long, text string, simhash string, extra int"


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    left, out = set(prints), {}
    while left:
        todo = [left.pop()]
        seen = list(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if (x ^ y).bit_count() <= 3}
            left -= near
            todo += near
            seen += near
        out |= dict.fromkeys(seen, min(seen))
    return out


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for _ in range(60):
        text = " ".join(rng.choice(["Ab", "c", "É", "é", "x\ty", "\n"]) for _ in range(rng.randint(0, 40)))
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)
    assert simhash.fingerprint(b" \t ") == 0


def test_components_match_brute_force(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(400):  # chains, and a crowd that shares keys
        x = rng.choice(prints[-80:])
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    core = rng.getrandbits(64)
    prints += [core ^ sum(1 << b for b in rng.sample(range(16), rng.randint(0, 6))) for _ in range(300)]
    signed = [x - (1 << 64) if x >> 63 else x for x in set(prints)]
    found = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    group = {r.node % (1 << 64): r.root for r in found}
    want = slow_components(prints)
    names = {}
    for x, name in want.items():
        alone = sum(v == name for v in want.values()) == 1
        assert (x not in group) == alone
        if not alone:
            assert names.setdefault(name, group[x]) == group[x]
    assert len(set(names.values())) == len(names)


def test_edge_cases(spark):
    rows = [
        Row(5, "one two three four", "s", 1), Row(3, "ONE two  three\tfour", "s", 1), Row(None, "one two three four", None, None),
        Row(9, None, "s", 2), Row(8, "", "s", 2), Row(7, "  ", "s", 2), Row(4, "quite another text " * 3000, "s", 3), Row(4, "quite another text " * 3000, "s", 3),
    ]
    docs = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    found = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert found == [(0, 3), (3, 3), (4, 4), (4, 4), (5, 3), (7, 7), (8, 7), (9, 7)]
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_whole_table(spark):
    import __spark_entry__

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    prints = {r.doc_id: slow_fingerprint(r.text or "") for r in docs}
    group = slow_components(list(prints.values()))
    least = {}
    for i, p in sorted(prints.items()):
        least.setdefault(group[p], i)
    got = __spark_entry__.queries()["op7_simhash"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{p:016x}", least[group[p]]) for i, p in prints.items()}
    assert len(got) == len(docs)


def test_components_of_a_million_edges(spark):
    n = 1_000_000
    edges = spark.range(n).select(F.xxhash64("id").alias("u"), F.xxhash64(F.col("id") + n).alias("v"))
    found = graph.components(edges)
    assert found.agg(F.count("*"), F.count_distinct("root")).first()[:] == (2 * n, n)
