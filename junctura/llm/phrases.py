"""Phrases whose words stand together more often than their parts do, by mergeable Misra-Gries summaries and an exact second pass.

Words are counted within pieces (texts cut at ``.,;:!?`` and line ends), per language. First pass: each chunk of documents sends its
counts of names of words and pairs, dealt by hash into partitions; a partition merges them into a Misra-Gries summary of a capacity of
six times its mass divided by the threshold, so what the summary has lost of a name stays under a sixth of the threshold, and every name that
is frequent is still there. Phrases of three and four words are asked only where all their pairs are left. Second pass: what is left is counted
by its words, exactly, and grouped by Spark. Names are 64-bit hashes; equal names of different words only let more through to the exact count.

A null text is empty, a null language ``und``. Repeated rows count each. Without documents there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .. import storage
from .asking import Chunk, Corpus, Heard, deal, groups, mixed
from .hashing import Blocks, equal, hashes

LEAST, MOST, COUNT, TOP, SHARE = 2, 4, 30, 2000, 80
_BREAK = np.isin(np.arange(256), [10, 11, 12, 13, *b".,;:!?"])
_GAP = _BREAK | np.isin(np.arange(256), [9, 32])
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
COUNTS = "lang string, phrase string, words int, f long"
#: A summary's capacity is so many times its mass divided by the threshold: over 1, every frequent name is kept; the more, the fewer others.
ROOM = 6
#: Parts of a language that are ranked on their own before all are.
SALT = 64


class Words:
    """Words of a chunk: places, hashes (of word and language), and how many breaks stand before each."""

    def __init__(self, c: Chunk):
        self.data = c.data.translate(_LOWER)
        a = np.frombuffer(self.data, "u1")
        gap = _GAP[a]
        edges = np.diff(np.concatenate([[True], gap, [True]]).view("i1"))
        self.starts, self.ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        self.piece = np.cumsum(_BREAK[a], dtype="i4")[self.starts] if len(a) else np.zeros(0, "i4")
        self.blocks = Blocks(self.data)
        self.langs = c.langs.fill_null("und").dictionary_encode()
        kinds = np.array([xxhash.xxh64_intdigest(x) for x in self.langs.dictionary.to_pylist()], "u8")
        row = np.searchsorted(c.starts, self.starts, side="right") - 1
        self.lang = self.langs.indices.to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, "i4")
        self.hash = mixed(hashes(self.data, self.blocks, self.starts, self.ends), kinds[self.lang]) if len(row) else np.zeros(0, "u8")

    def next(self, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of n words from those of n - 1, and whether no break stands between."""
        k = max(0, len(self.hash) - n + 1)
        return mixed(names[:k], self.hash[n - 1 :]), self.piece[n - 1 :] == self.piece[:k]


def _has(sorted_names: np.ndarray, names: np.ndarray) -> np.ndarray:
    if not len(sorted_names):
        return np.zeros(len(names), bool)
    return sorted_names[np.minimum(np.searchsorted(sorted_names, names), len(sorted_names) - 1)] == names


class State:
    """Which words and phrases of a chunk are still asked for."""

    def __init__(self, c: Chunk, answers: dict, most: int, upto: int):
        self.w = w = Words(c)
        pairs, whole = w.next(w.hash, 2)
        self.asked = np.unique(np.concatenate([w.hash, pairs[whole]]), return_counts=True)
        if upto == 0:
            return
        left = np.sort(self.asked[0][answers[0][0]]) if 0 in answers else self.asked[0][:0]
        word, pair = _has(left, w.hash), whole & _has(left, pairs)
        # by number of words: names and the places where a phrase may be frequent
        self.found, names = {1: (w.hash, word), 2: (pairs, pair)}, pairs
        for n in range(3, most + 1):
            names, whole = w.next(names, n)
            for k in range(n - 1):
                whole = whole & pair[k : k + len(whole)]
            self.found[n] = names, whole
        self.asked = np.unique(np.concatenate([w.hash[:0], *(names[some] for n, (names, some) in self.found.items() if n > 2)]), return_counts=True)
        if upto > 1:
            left = np.sort(self.asked[0][answers[1][0]]) if 1 in answers else left[:0]
            self.found = {n: (names, some if n < 3 else some & _has(left, names)) for n, (names, some) in self.found.items()}

    def ask(self, c: Chunk, buckets: int) -> Iterator[pa.RecordBatch]:
        yield from deal(c.id, self.asked[0], buckets, self.asked[0], self.asked[1].astype("<u4"))


class Summary:
    """Misra-Gries: at most ``capacity`` names; a count is short by at most ``lost``, which is under mass / capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.names, self.counts = np.zeros(0, "u8"), np.zeros(0, "i8")

    def merge(self, names: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        """Add another summary, or plain counts; a name may stand more than once."""
        names, counts = np.concatenate([self.names, names]), np.concatenate([self.counts, counts])
        order = np.argsort(names, kind="stable")
        starts = groups(names[order])
        self.names, self.counts = names[order][starts], np.add.reduceat(counts[order], starts) if len(starts) else counts
        self.lost += lost
        if len(self.names) > self.capacity:
            cut = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            some = self.counts > cut
            self.names, self.counts, self.lost = self.names[some], self.counts[some] - cut, self.lost + cut

    def may_have(self, count: int) -> np.ndarray:
        """Sorted names that can be as frequent; all that are, are among them."""
        return self.names[self.counts + self.lost >= count]


def _summarised(count: int):
    def answer(asked: Heard, k: int) -> Iterator[pa.RecordBatch]:
        names, counts = asked.column("a", "<u8"), asked.column("b", "<u4").astype("i8")
        summary = Summary(ROOM * int(counts.sum()) // count + 1)
        at, held = 0, 0
        for _, _, n in asked.rows(8):  # as many chunks at a time as the summary has room for
            held += n
            if held - at >= summary.capacity:
                summary.merge(names[at:held], counts[at:held])
                at = held
        summary.merge(names[at:], counts[at:])
        yield from asked.tell(k, 8, _has(summary.may_have(count), names))

    return answer


def _words(w: Words, some: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Ids of words, compared byte by byte, and the words; words of different languages have different ids."""
    ids = np.full(len(w.hash), -1)
    places = np.flatnonzero(some)
    _, first, of = np.unique(w.hash[places], return_index=True, return_inverse=True)
    size, lead = w.ends - w.starts, places[first]
    ids[places] = of
    like = lead[of]
    odd = (size[places] != size[like]) | (w.lang[places] != w.lang[like])
    odd[~odd] = ~equal(w.blocks, w.starts[places[~odd]], w.blocks, w.starts[like[~odd]], size[places[~odd]])
    more: dict[tuple, int] = {}
    lead = lead.tolist()
    for p in places[odd].tolist():  # other words of an equal hash
        key = (int(w.lang[p]), w.data[w.starts[p] : w.ends[p]])
        if key not in more:
            more[key] = len(lead)
            lead.append(p)
        ids[p] = more[key]
    return ids, pa.array([w.data[s:e] for s, e in zip(w.starts[lead].tolist(), w.ends[lead].tolist(), strict=True)], pa.binary())


def _counted(c: Chunk, answers: dict, most: int) -> Iterator[pa.RecordBatch]:
    s = State(c, answers, most, 2)
    w = s.w
    totals = np.bincount(w.lang, minlength=len(w.langs.dictionary))

    def batch(langs: pa.Array, phrases: pa.Array, n: int, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([langs, phrases.cast(pa.string()), pa.array(np.full(len(f), n), "i4"), pa.array(f, "i8")], ["lang", "phrase", "words", "f"])

    yield batch(w.langs.dictionary, pa.array([""] * len(totals)), 0, totals)
    # a phrase's words are all frequent, as are its pairs
    ids, words = _words(w, s.found[1][1])
    for n, (_, some) in s.found.items():
        at = np.flatnonzero(some)
        for k in range(n):
            at = at[ids[at + k] >= 0]
        parts = [ids[at + k] for k in range(n)]
        keys = [parts[k] << 32 | parts[k + 1] if k + 1 < n else parts[k] for k in range(0, n, 2)]
        order = np.lexsort(keys[::-1])
        starts = groups(*(k[order] for k in keys))
        first = order[starts]
        taken = [words.take(pa.array(p[first])) for p in parts]
        phrases = pc.binary_join_element_wise(*taken, pa.scalar(b" ", pa.binary())) if n > 1 else taken[0]
        yield batch(w.langs.dictionary.take(pa.array(w.lang[at[first]])), phrases, n, np.diff(np.append(starts, len(order))))


def phrase_counts(docs: DataFrame, held: storage.Tables, count: int = COUNT, most: int = MOST, chunk: int | None = None) -> DataFrame:
    """lang, phrase, words (1 to ``most``), f of all phrases that stand ``count`` times or more; with no words, f is the language's number of words."""
    corpus = Corpus(docs, held, chunk)
    n = corpus.buckets
    try:
        corpus.ask(lambda c, answers: State(c, answers, most, 0).ask(c, n), _summarised(count))
        corpus.ask(lambda c, answers: State(c, answers, most, 1).ask(c, n), _summarised(count))
        counts = corpus.visit(lambda c, answers: _counted(c, answers, most), COUNTS).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
        return held.stored(counts.filter((F.col("words") == 0) | (F.col("f") >= count)), "phrase-counts")
    finally:
        corpus.close()


def collocations(docs: DataFrame, count: int = COUNT, most: int = MOST, top: int = TOP, share: int = SHARE, chunk: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases, scored at their worst cut, without those inside a longer one as frequent."""
    with storage.tables(docs.sparkSession) as held:
        counts = phrase_counts(docs, held, count, most, chunk)
        candidates = counts.filter(F.col("words") >= LEAST).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
        part = counts.filter(F.col("words") > 0)

        def joined(start, size):
            return F.array_join(F.slice("w", start, size), " ")

        cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
        cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
        cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (l + r)"))
        best = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
        inner = candidates.filter(F.size("w") > LEAST).select("lang", "a", "w", F.explode(F.sequence(F.lit(LEAST), F.size("w") - 1)).alias("m")).select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
        inside = inner.groupBy("lang", joined(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
        free = best.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share))
        rows = free.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        # a language's rows are first ranked in parts, so that one task has top x SALT of them at most
        some = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
        total = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
        return storage.stored(ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
