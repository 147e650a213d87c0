import random

from junctura.llm import set_join, shingle_join, simhash
import corpus_pipeline as p

from .fixtures import documents, odd_texts


def sets_of(text, size=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def firsts(rows):
    """The smallest id of each component of pairs of Jaccard similarity 0.8 or more; texts without words are one."""
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4 > 0:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if root(i) == i}


def near_texts(seed, n=150):
    """Copies with a few words changed or put in, at other line breaks: many pairs from 0.7 to 0.95."""
    r = random.Random(seed)
    words = [f"v{i}" for i in range(500)]
    out = []
    for _ in range(n):
        w = r.choices(words, k=r.randint(6, 120)) if not out or r.random() < 0.4 else r.choice(out).split()
        for _ in range(r.randint(0, 3)):
            w.insert(r.randrange(len(w) + 1), r.choice(words)) if r.random() < 0.5 else w.__setitem__(r.randrange(len(w)), r.choice(words))
        out.append("".join(x + r.choice("    \n") for x in w))
    return out


def kept(df):
    return {r.doc_id for r in df.collect()}


def test_stage_against_brute_force(spark):
    rows = list(enumerate(odd_texts() + near_texts(1)))
    want = firsts(rows)
    df = documents(spark, rows)
    assert kept(p.simhash_near_dedup(spark, df, "")) == want
    assert len(kept(simhash.keep_first(df, 5))) > len(want) + 20  # what four bits alone leave twice
    assert p.simhash_near_dedup(spark, documents(spark), "").count() == 0


def test_long_lists_and_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(set_join, "LIST", 5)
    monkeypatch.setattr(set_join, "PROPOSALS", 1)
    rows = list(enumerate(near_texts(2, 80)))
    assert kept(shingle_join.keep_first(documents(spark, rows, extra=True))) == firsts(rows)
