"""Removal of long strings that stand in an earlier document, by prefix doubling over sampled positions.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id. Prefix doubling ranks strings
of one length, then pairs of ranks at an offset give those of twice the length, and a position that is unique is asked no more. Ranks here
are 64-bit names, so that a rank needs no sort of all positions:

1. Names of strings of half the length. Every string of ``length`` bytes holds one whose name is the least of its own (the leftmost of equal
   ones), and equal strings hold it at the same place; so only these positions are asked, about one in thirteen. Where no other document
   has the name, all strings around it are unique and go no further.
2. At the others, the whole of the strings that share the position, named in 128 bits: where an earlier document has that, all of them go.
   Where all documents that have the first name have the same surroundings, there is nothing more to ask.
3. For the rest, pairs of the names at p and at p + length - half: the name of the whole string at p. The earliest document that has it keeps it.

Each round is a shuffle of names by ranges, sorted in tasks (asking.py); texts are not shuffled. The result is exact but for equal hashes of
different strings: of 64 bits for halves, two or three of which must be equal at once.

A null text is empty. Rows with equal doc_id don't make each other's bytes go; a null doc_id is smaller than all others. Texts under
``length`` bytes stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .. import storage
from .asking import Chunk, Corpus, Heard, deal, groups, mixed
from .hashing import Blocks

LENGTH = 50
#: Positions that are looked at at once.
STEP = 1 << 17
_PLACES = np.uint64((1 << 22) - 1)
OUT = "doc_id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept_sha256 string"


def _names(data: bytes, at: int, n: int, size: int) -> np.ndarray:
    """Names of the strings of ``size`` bytes from n positions on."""
    part = np.zeros(n + size + 16, "u1")
    given = np.frombuffer(data, "u1", min(len(data) - at, n + size), at)
    part[: len(given)] = given
    words = np.empty(n + size, "u8")
    for k in range(8):
        some = part[k : k + (n + size - k + 7) // 8 * 8].view("<u8")
        words[k::8] = some
    places = [*range(0, size - 8, 8), size - 8]
    out = words[places[0] : places[0] + n]
    for p in places[1:]:
        out = mixed(out, words[p : p + n])
    return mixed(out, out)


class Positions:
    """Sampled positions of a chunk: names, the documents and the first and last strings that each stands for."""

    def __init__(self, c: Chunk, length: int):
        self.c, self.length, half = c, length, (length + 1) // 2
        window = length - half + 1
        found = []
        for at in range(0, max(0, len(c.data) - length + 1), STEP):
            n = min(STEP, len(c.data) - length + 1 - at)  # strings that start here
            names = _names(c.data, at, n + window - 1, half)
            least = (names & ~_PLACES) | np.arange(len(names), dtype="u8")
            reach = 1
            while reach < window:
                step = min(reach, window - reach)
                least = np.minimum(least[: len(least) - step], least[step:])
                reach += step
            place = (least & _PLACES).astype("i8")
            first, last = np.searchsorted(c.starts, [at, at + n - 1], side="right") - 1
            sound = np.zeros(n, bool)
            for s, e in zip((c.starts[first : last + 1] - at).tolist(), (c.ends[first : last + 1] - at - length + 1).tolist(), strict=True):
                sound[max(0, s) : max(0, e)] = True
            new = sound.copy()
            new[1:] &= ~sound[:-1] | (place[1:] != place[:-1])
            starts = np.flatnonzero(new)
            over = sound & np.concatenate([new[1:] | ~sound[1:], [True]])
            ends = np.flatnonzero(over)
            found.append((names[place[starts]], names[starts], names[starts + length // 2], names[ends + length // 2], starts + at, ends + at))
        parts = list(zip(*found, strict=True)) or [[np.zeros(0, t)] for t in ("u8", "u8", "u8", "u8", "i8", "i8")]
        self.names, *self.parts, self.first, self.last = (np.concatenate(p) for p in parts)
        self.row = np.searchsorted(c.starts, self.first, side="right") - 1
        self.doc = c.keys()[self.row] if len(self.row) else np.zeros(0, "i8")
        self.blocks = Blocks(c.data + bytes(16))

    def whole(self, some: np.ndarray, salt: int) -> np.ndarray:
        """Names of all that the strings of a position cover, of the names of the three halves that do, and of where it stands in it."""
        a, b, c = (p[some] for p in self.parts)
        size = (self.last[some] - self.first[some]).astype("u8")
        return mixed(mixed(mixed(a ^ np.uint64(salt), b), c), mixed(self.names[some], size))

    def strings(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the strings of some positions: starts, and pairs of names of their halves."""
        n = (self.last - self.first + 1)[some]
        at = np.repeat(self.first[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, "i8")
        return at, self._half(at), self._half(at + self.length // 2)

    def _half(self, at: np.ndarray) -> np.ndarray:
        half = (self.length + 1) // 2
        places = [*range(0, half - 8, 8), half - 8]
        out = self.blocks.at(at + places[0])
        for p in places[1:]:
            out = mixed(out, self.blocks.at(at + p))
        return mixed(out, out)


class _Distinct:
    """Distinct keys of a chunk in ascending order, the smallest document of each, and where each entry's key is."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, doc: np.ndarray):
        order = np.lexsort((lo, hi))
        starts = groups(hi[order], lo[order])
        self.hi, self.lo = hi[order][starts], lo[order][starts]
        self.doc = np.minimum.reduceat(doc[order], starts) if len(starts) else doc[:0]
        self.of = np.empty(len(order), "i8")
        self.of[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))

    def gone(self, doc: np.ndarray, answer: tuple | None) -> np.ndarray:
        """Whether an earlier document, here or elsewhere, has an entry's key."""
        elsewhere = np.zeros(len(self.hi), bool)
        if answer:
            elsewhere[answer[0]] = True
        return (doc > self.doc[self.of]) | elsewhere[self.of] if len(self.of) else np.zeros(0, bool)

    def ask(self, chunk: int, buckets: int) -> Iterator[pa.RecordBatch]:
        yield from deal(chunk, self.hi, buckets, self.hi, self.lo, self.doc)


class State:
    """How far a chunk has come, worked out from its text and the answers."""

    def __init__(self, c: Chunk, answers: dict, length: int, upto: int):
        self.p = p = Positions(c, length)
        self.order = np.argsort(p.names, kind="stable")
        names, doc = p.names[self.order], p.doc[self.order]
        starts = groups(names)
        self.names = names[starts]
        wide = p.whole(np.arange(len(p.names)), 0) | np.uint64(1)
        around = wide[self.order]
        many = np.zeros(len(starts), bool)
        if len(starts):
            several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
            many = np.minimum.reduceat(around, starts) != np.maximum.reduceat(around, starts)
        # surroundings of a name that has one here, else zero
        self.around = np.where(many, np.uint64(0), around[starts])
        if upto == 0:
            return
        asked, differ = np.zeros(len(starts), bool), many.copy()
        if len(starts):
            asked |= several
        if 0 in answers:
            asked[answers[0][0]] = True
            differ[answers[0][0]] |= answers[0][1].astype(bool)
        of = np.empty(len(self.order), "i8")
        of[self.order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(self.order))))
        self.second = np.flatnonzero(asked[of])
        self.wide = _Distinct(wide[self.second], p.whole(self.second, 1 << 32), p.doc[self.second])
        if upto == 1:
            return
        self.covered = self.wide.gone(p.doc[self.second], answers.get(1))
        third = self.second[~self.covered & differ[of[self.second]]]
        self.at, hi, lo = p.strings(third)
        # the first half's name is spread over the buckets no better than its documents, so the second is mixed in
        self.doc = np.repeat(p.doc[third], (p.last - p.first + 1)[third])
        self.pairs = _Distinct(mixed(hi, lo), lo, self.doc)


def _repeated(asked: Heard, k: int) -> Iterator[pa.RecordBatch]:
    """Names that several chunks have, marked where their surroundings differ."""
    names, around = asked.column("a", "<u4"), asked.column("b", "<u8")
    order = np.argsort(names, kind="stable")
    starts = groups(names[order])
    told, marks = np.zeros(len(names), bool), np.zeros(len(names), "u1")
    if len(starts):
        n = np.diff(np.append(starts, len(names)))
        least, most = (f.reduceat(around[order], starts) for f in (np.minimum, np.maximum))
        told[order], marks[order] = np.repeat(n > 1, n), np.repeat((least != most) | (least == 0), n)
    yield from asked.tell(k, 4, told, marks)


def _earlier(asked: Heard, k: int) -> Iterator[pa.RecordBatch]:
    """Keys that a chunk with a smaller document has."""
    hi, lo, doc = asked.column("a", "<u8"), asked.column("b", "<u8"), asked.column("c", "<i8")
    order = np.lexsort((lo, hi))
    starts = groups(hi[order], lo[order])
    told = np.zeros(len(hi), bool)
    if len(starts):
        told[order] = doc[order] > np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.append(starts, len(hi))))
    yield from asked.tell(k, 8, told)


def _result(c: Chunk, answers: dict, length: int) -> Iterator[pa.RecordBatch]:
    s = State(c, answers, length, 2)
    p, edges = s.p, np.zeros(len(c.data) + length + 1, "i4")
    whole = s.second[s.covered]
    np.add.at(edges, p.first[whole], 1)
    np.add.at(edges, p.last[whole] + length, -1)
    at = s.at[s.pairs.gone(s.doc, answers.get(2))]
    np.add.at(edges, at, 1)
    np.add.at(edges, at + length, -1)
    out = (np.cumsum(edges, dtype="i4") > 0)[: len(c.data)]
    # documents don't touch, so a removed run is of one document
    change = np.diff(np.concatenate([[False], out, [False]]).view("i1"))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    row = np.searchsorted(c.starts, starts, side="right") - 1
    sums = np.bincount(row, ends - starts, len(c.ids)).astype("i8")
    bounds = np.searchsorted(row, np.arange(len(c.ids) + 1))
    digests, view = [], memoryview(c.data)
    for k, (b, e) in enumerate(zip(c.starts[:-1].tolist(), c.ends.tolist(), strict=True)):
        h = hashlib.sha256()
        for x, y in zip(starts[bounds[k] : bounds[k + 1]].tolist(), ends[bounds[k] : bounds[k + 1]].tolist(), strict=True):
            h.update(view[b:x])
            b = y
        h.update(view[b:e])
        digests.append(h.hexdigest())
    lists = [pa.ListArray.from_arrays(pa.array(bounds, "i4"), pa.array(v - c.starts[row], "i8")) for v in (starts, ends)]
    yield pa.RecordBatch.from_arrays([c.ids, pa.array(c.ends - c.starts[:-1], "i8"), pa.array(sums, "i8"), *lists, pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "starts", "ends", "kept_sha256"])


def repeats(docs: DataFrame, length: int = LENGTH, chunk: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, starts and ends (byte offsets) of the runs to remove, kept_sha256 of the other bytes; a row for each document."""
    if length < 16:
        raise ValueError("strings of 16 bytes at least")
    with storage.tables(docs.sparkSession) as held:
        corpus = Corpus(docs, held, chunk)
        n = corpus.buckets
        try:

            def first(c: Chunk, answers: dict) -> Iterator[pa.RecordBatch]:
                s = State(c, answers, length, 0)
                yield from deal(c.id, s.names, n, s.names.astype("<u4"), s.around)

            corpus.ask(first, _repeated)
            corpus.ask(lambda c, answers: State(c, answers, length, 1).wide.ask(c.id, n), _earlier)
            corpus.ask(lambda c, answers: State(c, answers, length, 2).pairs.ask(c.id, n), _earlier)
            return storage.stored(corpus.visit(lambda c, answers: _result(c, answers, length), OUT), "repeats")
        finally:
            corpus.close()
