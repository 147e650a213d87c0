"""Small tables with the odd cases that operators must stand."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_texts():
    return [None, "", " ", "\n\n", "one", "one two\nthree", "ein Wörterbuch für Übung — 漢字 \U0001f600 straße", "a" * 5000, "x " * 3000, "  lead\tand\ttail \n"]


def texts(n=120, seed=1):
    """Texts of few words, with exact and near copies, so that joins find much."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(400)]
    out = []
    for _ in range(n):
        lines = [" ".join(r.choices(vocabulary, k=r.randint(1, 14))) for _ in range(r.randint(1, 5))]
        if out and r.random() < 0.5:
            lines = [line for line in r.choice(out).split("\n")]
            k = r.randrange(len(lines))
            w = lines[k].split()
            if r.random() < 0.7:
                w[r.randrange(len(w))] = r.choice(vocabulary)
            lines[k] = " ".join(w)
        out.append("\n".join(lines))
    return out


def documents(spark, rows=None, extra=False):
    """rows: (doc_id, text). extra: more columns, some with names that operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in (rows or [])], DOCS)
    if extra:
        from pyspark.sql import functions as F

        for c in ("d", "h", "token", "node", "fingerprint", "phrase", "piece", "start", "line", "_number", "words"):
            df = df.withColumn(c, F.lit("clash"))
    return df
