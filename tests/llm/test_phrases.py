"""Phrases against plain counting, and the summaries' guarantee."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from junctura.llm import oracles, phrases

from .fixtures import odd_texts

DOCS = "doc_id long, text string, lang string, a long, l string, rank int, n int"


def rows(seed=1, n=150):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(25)] + ["Été", "漢字", "Was", "was"]
    said = [" ".join(r.choices(words, k=r.randint(2, 5))) for _ in range(8)]
    out = []
    for k in range(n):
        t = "".join(r.choice(said) + r.choice([" ", ", ", ".\n", "  ", "\t", "\x0b"]) if r.random() < 0.5 else r.choice(words) + r.choice([" ", "!", " "]) for _ in range(r.randint(1, 60)))
        out.append((k, t, r.choice(["en", "en", "en", "fr", None])))
    return out + [(1000 + k, t, "de") for k, t in enumerate(odd_texts())] + [out[3], out[3], (None, out[4][1], "fr")]


def brute(rows, count=30, most=4, top=2000, share=80):
    out = []
    by = {}
    for _, t, lang in rows:
        by.setdefault(lang or "und", []).append(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for lang, texts in by.items():
        f, n = Counter(), 0
        for t in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
                w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
                n += len(w)
                f.update(tuple(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= count}
        inside = {}
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside.get(p[i : i + m], 0), a)
        kept = []
        for p, a in cand.items():
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not 100 * inside.get(p, -1) >= share * a:
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*x, 1, "clash", 2, 3) for x in rows], DOCS)


@pytest.mark.parametrize(("chunk", "count", "top"), [(None, 30, 2000), (1500, 30, 20), (300, 7, 2000)])
def test_collocations(spark, chunk, count, top):
    got = sorted(tuple(r) for r in phrases.collocations(table(spark, rows()), count=count, top=top, chunk=chunk).collect())
    assert got == brute(rows(), count, top=top) and len(got) > 30


def test_sql(spark):
    con = duckdb.connect()
    con.register("documents", table(spark, rows()).toPandas())
    assert sorted(con.execute(oracles.PHRASES).fetchall()) == brute(rows())


def test_equal_hashes(spark, monkeypatch):
    """Words are told apart where their hashes are equal."""
    from junctura.llm.asking import Chunk  # noqa: F401
    import pyarrow as pa

    data = b"aa bb cc aa bb\ndd"
    w = phrases.Words(type("C", (), {"data": data, "starts": np.array([0, 15, 18]), "langs": pa.array(["en", "en"])})())
    w.hash[:] = 7
    ids, words = phrases._words(w, np.ones(6, bool))
    assert ids[0] == ids[3] and ids[1] == ids[4] and len({*ids.tolist()}) == 4
    assert [words[i].as_py() for i in ids] == data.replace(b"\n", b" ").split()


def test_empty(spark):
    assert phrases.collocations(table(spark, [])).count() == 0
    assert phrases.collocations(table(spark, [(1, None, None), (2, "", "en"), (3, "...", "en")])).count() == 0


def test_summary():
    r = np.random.default_rng(5)
    for seed in range(20):
        stream = r.zipf(1.3, 3000).astype("u8") % np.uint64(500)
        threshold = 30
        whole = phrases.Summary(2 * len(stream) // threshold + 1)
        for part in np.array_split(stream, 1 + seed):
            one = phrases.Summary(whole.capacity)
            for block in np.array_split(part, 7):
                one.merge(*np.unique(block, return_counts=True))
            whole.merge(one.names, one.counts, one.lost)
        names, counts = np.unique(stream, return_counts=True)
        true = dict(zip(names.tolist(), counts.tolist(), strict=True))
        assert len(whole.names) <= whole.capacity and whole.lost * (whole.capacity + 1) <= len(stream)
        assert {x for x, c in true.items() if c >= threshold} <= set(whole.may_have(threshold).tolist())
        assert all(true[x] - whole.lost <= c <= true[x] for x, c in zip(whole.names.tolist(), whole.counts.tolist(), strict=True))
