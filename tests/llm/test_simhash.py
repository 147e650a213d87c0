import random

import numpy as np
import xxhash

from junctura import storage
from junctura.llm import simhash
from junctura.operators.graph import components

from .fixtures import documents, odd_texts, texts


def print_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    n = min(4, len(low))
    shingles = [b" ".join(low[i : i + n]) for i in range(len(low) - n + 1)] if low else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(ids, prints, link=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= link:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return {x: min(g) for g in groups.values() for x in g}


def test_documents(spark):
    rows = list(enumerate(odd_texts() + texts(120, seed=3)))
    got = simhash.near_duplicates(documents(spark, rows, extra=True)).collect()
    prints = [print_of(t) for _, t in rows]
    assert {r.doc_id: r.fingerprint % (1 << 64) for r in got} == dict(zip([i for i, _ in rows], prints))
    assert {r.doc_id: r.component_id for r in got} == reach([i for i, _ in rows], prints)
    kept = {r.doc_id for r in simhash.keep_first(documents(spark, rows)).collect()}
    assert kept == {r.component_id for r in got}


def near(seed, n=300):
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(n // 3)}
    while len(out) < n:
        x = r.choice(sorted(out))
        for b in r.sample(range(64), r.randint(1, 6)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def linked(spark, prints):
    signed = np.array(prints, "u8").view("i8").tolist()
    classes = spark.createDataFrame(list(enumerate(signed)), "node long, fingerprint long")
    got = {r.node: r.component for r in components(simhash.links(classes, storage.Tables(spark))).collect()}
    return {i: got.get(i, i) for i in range(len(prints))}


def test_links_against_brute_force(spark):
    for seed in (1, 2):
        prints = near(seed)
        assert linked(spark, prints) == reach(list(range(len(prints))), prints)


def test_long_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    prints = near(3, 150)
    assert linked(spark, prints) == reach(list(range(len(prints))), prints)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (3, 1), (None, 4)], "a long, b long")
    assert {(r.node, r.component) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in components(chain).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(documents(spark)).count() == 0
    rows = [(None, "a b c d e"), (3, "a b c d e"), (None, "q w e r t y"), (3, "a b c d e")]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(documents(spark, rows)).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (3, 3)]
    kept = [(r.doc_id, r.text) for r in simhash.keep_first(documents(spark, rows)).collect()]
    assert sorted(kept, key=str) == [(None, "a b c d e"), (None, "q w e r t y")]
