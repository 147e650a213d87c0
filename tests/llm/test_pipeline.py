"""The pipeline's stages against brute force on a small fixture."""

import corpus_pipeline as p
from junctura import storage

from .fixtures import documents, odd_texts, texts
from .test_line_dedup import brute
from .test_simhash import reach
from .test_tokens import whole


def print5(text):
    import xxhash

    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    n = min(5, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_stages(spark, tmp_path):
    given = [t.replace("\n", ".\n") + "." for t in texts(160, seed=9)]
    rows = list(enumerate(given + odd_texts()))
    bench = [(1, given[0]), (2, "no such words at all")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES:
        docs = storage.stored(stage(spark, docs, str(tmp_path)), "stage")
        seen[name] = docs.collect()
        if name != p.STAGES[-1][0]:
            assert docs.columns == list(p.COLUMNS) and all(r.n_chars == len(r.text) for r in seen[name])
    texts_of = lambda name: {r.doc_id: r.text for r in seen[name]}
    first = texts_of("quality rules")
    assert all(t == given[i] for i, t in first.items() if i < 160) and len(first) > 60
    want = dict(zip(sorted(first), brute(list(first.items()))))
    second = texts_of("line dedup")
    assert second == {i: t for i, t in want.items() if t.split()}
    ids = sorted(second)
    groups = reach(ids, [print5(second[i]) for i in ids])
    third = texts_of("SimHash near-dedup")
    assert third == {i: second[i] for i in ids if groups[i] == i}
    fourth = texts_of("benchmark decontamination")
    phrases = {tuple(w[k : k + 10]) for _, t in bench for w in [t.lower().replace(".", " ").split()] for k in range(max(1, len(w) - 9))}
    hit = lambda t: any(tuple(w[k : k + len(q)]) == q for w in [t.lower().replace(".", " ").split()] for q in phrases for k in range(len(w)))
    assert fourth == {i: t for i, t in third.items() if not hit(t)} and len(fourth) < len(third)
    assert sum(r.length for r in seen["best-fit packing"]) == sum(len(whole(t)) for t in fourth.values())
    assert {tuple(r) for r in p.run(spark, str(tmp_path)).select("doc_id", "piece", "length").collect()} == {(r.doc_id, r.piece, r.length) for r in seen["best-fit packing"]}
