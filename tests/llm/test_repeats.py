"""Removal of repeated strings against a search of every string."""

import hashlib
import random

import pytest

from junctura.llm import repeats

from .fixtures import documents, odd_texts, texts


def brute(rows, length):
    first = {}
    key = lambda i: float("-inf") if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, float("inf")), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(i):
                gone[p : p + length] = b"\1" * length
        n = sum(gone[p] and (p == 0 or not gone[p - 1]) for p in range(len(b)))
        out.append((i, len(b), sum(gone), n, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256) for r in df.collect()), key=repr)


def planted(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé漢", k=r.randint(1, 9)))
    passages = [" ".join(word() for _ in range(r.randint(8, 30))) for _ in range(6)]
    out = [" ".join(r.choice(passages) if r.random() < 0.3 else " ".join(word() for _ in range(r.randint(1, 20))) for _ in range(r.randint(1, 6))) for _ in range(120)]
    # cut at odd places, so that matches begin and end inside words; runs of one character; copies
    out += [t[r.randrange(len(t)) :] + t[: r.randrange(len(t))] for t in out[:40]] + out[:10] + ["a" * 300, "b" + "a" * 120, "ab" * 90, passages[0], passages[0][1:]] + [passages[1] + word() for _ in range(20)]
    ids = [*range(len(out) - 6), 3, 3, None, None, 7, -5]
    r.shuffle(ids)
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize(("length", "chunk", "step"), [(50, None, 1 << 17), (50, 2000, 700), (16, 1000, 1 << 17), (33, 500, 64)])
def test_repeats(spark, monkeypatch, length, chunk, step):
    rows = planted(length) + [(1000 + k, t) for k, t in enumerate(odd_texts() + texts(40))]
    if step != 1 << 17:
        monkeypatch.setattr(repeats, "STEP", step)  # seen by the driver's check only where tasks share its process
    assert found(repeats.repeats(documents(spark, rows, extra=True), length, chunk)) == brute(rows, length)


def test_positions_in_steps(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from junctura.llm.asking import Chunk

    texts_ = [t.encode() for _, t in planted(3)]
    starts = np.cumsum([0] + [len(t) + 1 for t in texts_])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([list(range(len(texts_)))]), pa.array([["en"] * len(texts_)]), pa.array([starts.astype("i8").tobytes()]), pa.array([b"\n".join(texts_)])], ["chunk", "ids", "langs", "offsets", "data"])
    strings = []
    for step in (1 << 17, 777, 64):
        monkeypatch.setattr(repeats, "STEP", step)
        p = repeats.Positions(Chunk(batch, 0), 50)
        at, _, _ = p.strings(np.arange(len(p.first)))
        strings.append(sorted(at.tolist()))
    assert strings[0] == strings[1] == strings[2] == [int(s) + k for s, t in zip(starts, texts_, strict=False) for k in range(len(t) - 49)]


def test_empty(spark):
    assert repeats.repeats(documents(spark)).count() == 0
    with pytest.raises(ValueError):
        repeats.repeats(documents(spark), 5)
