import pyarrow as pa

from junctura.llm import hashing, line_dedup, set_join

from .fixtures import documents, odd_texts, texts


def brute(rows):
    """doc_id, text pairs in order: text without the lines that an earlier one is like."""
    seen, out = [], []
    for _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        if text is None:
            out.append(None)
            continue
        kept = []
        for line in text.split("\n"):
            s = set(line.encode().split())
            if not s or not any(len(s & e) * 5 >= len(s | e) * 4 for e in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out.append("\n".join(kept))
    return out


def result(df):
    return [r.text for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))]


def test_against_brute_force(spark):
    rows = list(enumerate(texts(150)))
    assert result(line_dedup.dedup_lines(documents(spark, rows))) == brute(rows)


def test_long_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(set_join, "LIST", 5)
    monkeypatch.setattr(set_join, "PROPOSALS", 1)
    rows = list(enumerate(texts(100, seed=5)))
    assert result(line_dedup.dedup_lines(documents(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = list(enumerate(odd_texts()))
    df = line_dedup.dedup_lines(documents(spark, rows, extra=True))
    assert result(df) == brute(rows) and "token" in df.columns
    assert line_dedup.dedup_lines(documents(spark)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c\nd e"), (1, "a b c\nf g"), (1, "a b c\nd e"), (None, "d e"), (2, None)]
    got = {(r.doc_id, r.text, r.lines.n_lines, r.lines.n_removed) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {(None, "d e", 1, 0), (1, "a b c", 2, 1), (1, "", 2, 2), (1, "f g", 2, 1), (2, None, 0, 0)}


def test_equal_tokens_of_a_line(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "TOKEN_BITS", 3)
    words = [f"word{k}" for k in range(60)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:30])), *((2 + i, t) for i, t in enumerate(texts(40, seed=7)))]
    got = result(line_dedup.dedup_lines(documents(spark, rows)))
    assert got == brute(rows) and got[:2] == [t for _, t in rows[:2]]


def test_words_of_equal_polynomial_hashes(spark):
    a = "".join("ab"[k.bit_count() & 1] for k in range(2048))
    rows = [(0, f"one {a} two"), (1, f"one {a.translate({97: 98, 98: 97})} two"), (2, f"{a}\n{a.translate({97: 98, 98: 97})}")]
    assert result(line_dedup.dedup_lines(documents(spark, rows))) == brute(rows) == [t for _, t in rows]


def test_long_texts_are_cut_at_line_feeds(spark, monkeypatch):
    monkeypatch.setattr(hashing, "STEP", 40)
    rows = list(enumerate(["\n".join(texts(30, seed=9)), "x " * 100, *texts(30, seed=9)[5:9]]))
    assert [len(p[0]) for p in hashing.pieces(pa.array([rows[0][1]]))][5] <= 200
    assert result(line_dedup.dedup_lines(documents(spark, rows))) == brute(rows)
