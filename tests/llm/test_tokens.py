import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from junctura import storage
from junctura.llm import hashing, packing, token_files, tokens

from .fixtures import documents, odd_texts, texts

PATH = tokens.default_tokenizer()
MORE = ["  a", "a  b", "a\nb", " x\n\ny", "\ta b\t", "foo<|endoftext|> bar", "ſ x y", "it's a\x1cb", "a\x1c b", "don 't x 's", "é a", "a.b, c! ... d?", "x y z"]


def whole(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_fragments_give_the_library_ids():
    given = odd_texts() + MORE + texts(40)
    got = [np.frombuffer(b, "<u4").tolist() for b in tokens.encoded(PATH, given, batch=7)]
    assert got == [whole(t) for t in given]


def test_round_trip_of_files(spark):
    rows = [(i * 3, t) for i, t in enumerate(odd_texts() + MORE + texts(40))] + [(None, "no id"), (6, "again")]
    uri = token_files.write(documents(spark, rows, extra=True), storage.new_dir(spark, "t"), parts=5)
    got = token_files.read(spark, uri).collect()
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = whole(t)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got if r.doc_id is not None) == [w for w in want if w[0] is not None]
    assert [tuple(r) for r in got if r.doc_id is None] == [want[0]]
    empty = token_files.write(documents(spark), storage.new_dir(spark, "t"))
    assert token_files.read(spark, empty).count() == 0


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.integers(1, 101, 60)
        bins, offsets, n = packing.best_fit_decreasing(x, 100)
        fill = np.bincount(bins, weights=x)
        assert len(fill) == n and fill.max() <= 100
        assert packing.lower_bound(*np.unique(x, return_counts=True), 100) <= n <= 1.25 * x.sum() / 100 + 20
        for b in range(n):
            k = np.flatnonzero(bins == b)[np.argsort(offsets[bins == b])]
            assert offsets[k].tolist() == (np.cumsum(x[k]) - x[k]).tolist()
    assert packing.lower_bound(np.array([51]), np.array([9]), 100) == 9
    assert packing.lower_bound(np.array([34]), np.array([9]), 100) == 5
    assert packing.best_fit_decreasing(np.array([100, 50, 50]), 100)[2] == 2


@pytest.mark.parametrize("items", [40_000, 12])
def test_packing(spark, monkeypatch, items):
    monkeypatch.setattr(packing, "ITEMS", items)
    rows = list(enumerate(odd_texts() + texts(60))) + [(3, "again"), (None, "x")]
    packed, report = packing.pack_documents(documents(spark, rows, extra=True), capacity=64, keep_ids=True)
    got = packed.collect()
    assert sum(r.length for r in got) == sum(len(whole(t)) for _, t in rows)
    by_doc = {}
    for r in got:
        if r.doc_id not in (3, None):
            by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        if i in (3, None):
            continue
        pieces, ids = sorted(by_doc[i], key=lambda r: r.piece), whole(t)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and all(r.length == 64 for r in pieces[1:])
        assert b"".join(r.ids for r in pieces) == np.array(ids, "<u4").tobytes()
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in pieces)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(seqs) == report["bins"] + report["full"] and report["bins"] >= report["bound"]
    assert packing.sequences(packed).count() == len(seqs)
    assert packing.pack_documents(documents(spark))[0].count() == 0


def least_bins(x, capacity):
    """Fewest bins, by trying all."""
    best = len(x)

    def place(k, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if k == len(x):
            best = len(gaps)
            return
        for i in range(len(gaps)):
            if gaps[i] >= x[k] and gaps[i] not in gaps[:i]:
                place(k + 1, [*gaps[:i], gaps[i] - x[k], *gaps[i + 1 :]])
        place(k + 1, [*gaps, capacity - x[k]])

    place(0, [])
    return best


def test_bound_and_certificate_against_the_optimum():
    r = np.random.default_rng(3)
    certified = 0
    for _ in range(60):
        x = r.integers(1, 101, r.integers(1, 9))
        bound, found, best = packing.lower_bound(*np.unique(x, return_counts=True), 100), packing.best_fit_decreasing(x, 100)[2], least_bins(sorted(x.tolist(), reverse=True), 100)
        assert bound <= best <= found <= best + 1
        certified += found == bound
    assert certified > 50


def test_words_of_equal_polynomial_hashes():
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2 ** 64 for any odd base."""
    encoder = tokens.FragmentEncoder(tokens.default_tokenizer())
    for n in (1024, 2048, 4096):
        a = "".join("ab"[k.bit_count() & 1] for k in range(n))
        b = a.translate({97: 98, 98: 97})
        given = [f"x {a} y {b} z", f"{b} {a}", a, b]
        assert [x.tolist() for x in encoder.encode(given)] == [whole(t)[:-1] for t in given]


def test_colliding_words_get_their_own_ids(monkeypatch):
    true = hashing.hashes
    monkeypatch.setattr(hashing, "hashes", lambda *a: true(*a) & np.uint64(0xFF))
    given = [t for t in texts(60) if t]
    assert [x.tolist() for x in tokens.FragmentEncoder(tokens.default_tokenizer()).encode(given)] == [whole(t)[:-1] for t in given]
