"""SQL and DataFrame results of the native operators on small fixtures."""

import duckdb
import pytest

from junctura.llm import decontamination, oracles, quality

from .fixtures import documents, odd_texts, texts

LINES = ["Home | About | Contact", "All rights reserved.", "a### b$$$ c%%%", "no mark at the end here", "A fine line of text.", "one two three four five six seven eight nine ten."]


def rows():
    return list(enumerate(odd_texts() + texts(40) + ["\n".join(LINES), "\n".join(LINES[4:] * 3), LINES[0], " ".join(LINES[5:] * 4)])) + [(3, "one two"), (3, "one two")]


def items():
    t = texts(40)
    return [(1, t[0]), (2, " ".join(t[1].split()[2:9])), (3, t[2].upper()), (4, None), (5, ""), (6, "w1"), (7, t[0]), (10, "漢字 \U0001f600")]


def compared(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toPandas())
    con.execute("set threads = 2")
    want = con.execute(sql).fetchall()
    names = [c[0] for c in con.description]
    return sorted(map(tuple, df.select(*names).collect()), key=repr), sorted(want, key=repr)


def test_quality(spark):
    docs = documents(spark, rows(), extra=True)
    judged = quality.quality_rules(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got, want = compared(judged.select("doc_id", *(f"quality.{c}" for c in names)), oracles.QUALITY, documents=documents(spark, rows()))
    assert got == want and quality.quality_rules(documents(spark)).count() == 0
    clean = [r.quality for r in judged.collect() if r.text == "\n".join(LINES)][0]
    assert clean.clean_text == "\n".join(LINES[4:]) and clean.n_lines_removed == 4


@pytest.mark.parametrize("rows_broadcast", [200_000, -1])
def test_decontamination(spark, monkeypatch, rows_broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", rows_broadcast)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    found = decontamination.contamination(documents(spark, rows(), extra=True), bench).withColumnRenamed("d", "doc_id")
    got, want = compared(found, oracles.DECONTAMINATION, documents=documents(spark, rows()), benchmark=bench)
    assert got == want and any(r[-1] for r in got)
    assert decontamination.contamination(documents(spark), bench).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(documents(spark, rows()), bench.limit(0)).collect())


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    docs = documents(spark, [(1, "x alpha beta gamma more delta epsilon zeta eta theta iota kappa"), (2, "alpha q q q q q q q q q q beta gamma delta epsilon zeta eta theta iota kappa")])
    assert {r.doc_id for r in decontamination.proximity_matches(docs, bench, slop=2).collect()} == {1}
