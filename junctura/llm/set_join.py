"""Exact set-similarity join: candidates by prefix, length and positional filters and by parity bounds, in rounds.

Items are sets of tokens with an id (d, line). A pair that is similar enough (Jaccard) shares a token among the first of each in any one
order; the order is by rarity: by counts in a table of a fixed number of cells that tokens are hashed to, then by token. The cells keep what each worker reads
at a fixed size. Lists of the items with a token in their prefix are searched by bands of length (a partner's length is within a quarter).

From each list an item proposes only its earliest partners that pass; who calls verifies them and asks again for items that have more.
Postings travel in packed buckets, so Spark shuffles rows of some thousand postings and a task holds one bucket. Only tokens
that may have long lists travel as rows, as their lists are cut into chunks and pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import storage
from . import hashing

SIMILARITY = (4, 5)  # Jaccard, as a fraction
CELL_BITS = 21
#: Members of a token's list that one task holds; longer lists are cut into chunks, and pairs of chunks are tasks.
LIST = 50_000
#: Postings of a bucket, and of one that a task holds while it packs.
BUCKET, PACKED = 60_000, 120_000
#: Partners that an item proposes from one list in the first round.
PROPOSALS = 4
#: What a join broadcasts at most, in numbers of eight bytes or less.
BROADCAST_NUMBERS = 2_000_000
#: Cells of tokens, by which lists are picked before they are joined.
MARKS = 1 << 24
#: Sets of more tokens have a wide parity.
WIDE = 64

POSTING = np.dtype([("token", "<i8"), ("n", "<i4"), ("place", "<i4"), ("line", "<i4"), ("d", "<i8"), ("t", "<i8"), ("p", "<u8")])
#: Columns of items: id, size, digest of what they were made from, parity (one word, or four of a long one), token and place arrays (the prefix;
#: tokens are negative where their list may be long; empty where an item of the same digest asks for it).
ITEM = "d long, line int, n int, t long, t2 long, parity array<long>, token array<long>, place array<int>"


def _word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    return (hashing.words(buf)[0] for buf, *_ in hashing.pieces(texts))


def cell_counts(docs: DataFrame, where: str, hashes=_word_hashes) -> str:
    """How many tokens fall to each of the 2 ** CELL_BITS cells; of all texts. A table (cell, n) under ``where``, for rarity()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, "i8")
        for b in batches:
            for h in hashes(b["text"]):
                np.add.at(total, h >> np.uint64(64 - CELL_BITS), 1)
        some = np.flatnonzero(total)
        for a in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_pydict({"cell": pa.array(some[a : a + 100_000].astype("i4")), "n": pa.array(total[some[a : a + 100_000]])})

    docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).write.parquet(where)
    return where


_RARITY: dict[str, np.ndarray] = {}


def grade(counts: np.ndarray) -> np.ndarray:
    """Counts as grades of 0 to 127, five to an octave; 5 is a count of one."""
    return np.minimum(127, 5 * np.log2(counts + 1.0)).astype("u1")


def rarity(where: str) -> np.ndarray:
    """cell_counts()' table as grades, an array of a fixed size; read once per worker."""
    if where not in _RARITY:
        import pyarrow.dataset as ds

        fs, at = storage.filesystem(where)
        grades = np.zeros(1 << CELL_BITS, "u1")
        for b in ds.dataset(at, filesystem=fs, format="parquet").to_batches():
            grades[b["cell"].to_numpy()] = grade(b["n"].to_numpy())
        _RARITY.clear()
        _RARITY[where] = grades
    return _RARITY[where]


def prefix(n: np.ndarray) -> np.ndarray:
    """Tokens of a set of n of which one is shared by each set that is similar enough."""
    p, q = SIMILARITY
    return n + (p * n // -q) + 1


def parities(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of sets of hashes that begin at ``starts``: 256 bits in four words, one flipped by each token. Two sets differ in as many tokens as bits at least."""
    bit = hashing.mix(h, 0x94D049BB133111EB) >> np.uint64(56)
    one, word = np.uint64(1) << (bit & np.uint64(63)), bit >> np.uint64(6)
    return np.stack([np.bitwise_xor.reduceat(np.where(word == w, one, np.uint64(0)), starts) for w in range(4)], 1)


def sets(h: np.ndarray, owner: np.ndarray, grades: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """Of tokens with their owners (ascending, under 2 ** 17 apart): owner, n, parities of each set, and offsets, tokens (``bits`` bits), places of the prefixes."""
    long = int(grade(np.array([LIST]))[0])
    g = grades[h >> np.uint64(64 - CELL_BITS)].astype("u8")
    key = ((owner - owner[0]).astype("u8") << np.uint64(47)) | (g << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
    order = np.argsort(key)
    key, h = key[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
    key, h = key[new], h[new]
    number, g = (key >> np.uint64(47)).view("i8"), (key >> np.uint64(40)).view("i8") & 127
    first = np.ones(len(h), bool)
    first[1:] = number[1:] != number[:-1]
    starts = np.flatnonzero(first)
    n = np.diff(np.concatenate([starts, [len(h)]]))
    place = np.arange(len(h)) - np.repeat(starts, n)
    # a token that occurs once in all texts has no partner
    used = (place < np.repeat(prefix(n), n)) & (g != 5)
    token = (h & np.uint64((1 << bits) - 1)).view("i8")
    token = np.where(g >= long, -1 - token, token)[used]
    offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(used.astype("i8"), starts))])
    return number[starts] + owner[0], n, parities(h, starts), offsets, token, place[used]


def item_columns(fresh: np.ndarray, n: np.ndarray, parity: np.ndarray, offsets: np.ndarray, token: np.ndarray, place: np.ndarray) -> dict[str, pa.Array]:
    """parity, token and place of ITEM; those that are not fresh have none."""
    size, words = np.diff(offsets), np.where(fresh, np.where(n > WIDE, 4, 1), 0)
    flat = np.where(np.repeat(n > WIDE, 4), parity.ravel(), np.repeat(np.bitwise_xor.reduce(parity, 1), 4))[(np.arange(4) < words[:, None]).ravel()]
    keep, at = np.repeat(fresh, size), np.concatenate([[0], np.cumsum(np.where(fresh, size, 0))])
    return {"parity": _ragged(flat.view("i8"), np.concatenate([[0], np.cumsum(words)])), "token": _ragged(token[keep], at), "place": _ragged(place[keep].astype("i4"), at)}


def _ragged(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.array(values))


def _bands() -> np.ndarray:
    """Longest line of each band of lengths: partners of a line are in its own band or a next one."""
    ends = [1]
    while ends[-1] < 1 << 31:
        ends.append(max(ends[-1] + 1, ends[-1] * SIMILARITY[1] // SIMILARITY[0]))
    return np.array(ends)


BANDS = _bands()


def partners(f: np.ndarray, wide: np.ndarray, cell: np.ndarray, mine: np.ndarray | None, group: np.ndarray | None, asks: np.ndarray, skip: int, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of postings f of whole lists (wide: the wide parity's words, zeros where there is none; cell: number of the list or pair of chunks).

    Rows x, y of the ``take`` pairs after the first ``skip`` that pass, for each x that asks, where y is an earlier line than x; and the x that have
    more. ``mine`` (chunk of a row) and ``group``: where given, only pairs of unlike ones are looked at.
    """
    order = np.lexsort((f["line"], f["d"]))
    # equal lines are one, the earliest
    same = np.lexsort((f["p"][order], f["t"][order], cell[order]))  # stable
    g = order[same]
    keep = np.ones(len(g), bool)
    keep[1:] = (cell[g[1:]] != cell[g[:-1]]) | (f["t"][g[1:]] != f["t"][g[:-1]]) | (f["p"][g[1:]] != f["p"][g[:-1]])
    kept = np.zeros(len(f), bool)
    kept[g[keep]] = True
    rows = order[kept[order]]  # in (d, line) order
    f, wide, asks = f[rows], wide[rows], asks[rows]
    unlike = [k[rows] for k in (mine, group) if k is not None]
    _, cell = np.unique(cell[rows], return_inverse=True)
    m, bands = len(f), len(BANDS) + 2
    slot = (cell * bands + 1 + np.searchsorted(BANDS, f["n"])) * m
    at = slot + np.arange(m)
    sequence = np.argsort(at)
    sorted_at = at[sequence]
    n, left, p, d, line, long = f["n"].astype("i8"), (f["n"] - f["place"]).astype("i8"), f["p"], f["d"], f["line"], f["n"] > WIDE
    a, b = SIMILARITY
    passed, xs, ys = np.zeros(m, "i8"), [], []
    asking = np.flatnonzero(asks)
    for band in (0, -1, 1):
        low = np.searchsorted(sorted_at, slot[asking] + band * m)
        high = np.searchsorted(sorted_at, at[asking] + band * m)
        x = asking
        while True:
            open_ = (low < high) & (passed[x] <= skip + take)
            x, low, high = x[open_], low[open_], high[open_]
            if not len(x):
                break
            y = sequence[low]
            low = low + 1
            both = n[x] + n[y]
            need = -(-a * both // (a + b))
            ok = np.minimum(left[x], left[y]) >= need
            xo, yo, most = x[ok], y[ok], (both - 2 * need)[ok]
            ok = (np.bitwise_count(p[xo] ^ p[yo]) <= most) & ((d[xo] != d[yo]) | (line[xo] != line[yo]))  # two tokens of a line may be equal in the bits kept
            for k in unlike:
                ok &= k[xo] != k[yo]
            xo, yo, most = xo[ok], yo[ok], most[ok]
            far = np.flatnonzero(long[xo] & long[yo])
            if len(far):
                ok = np.ones(len(xo), bool)
                ok[far] = np.bitwise_count(wide[xo[far]] ^ wide[yo[far]]).sum(1) <= most[far]
                xo, yo = xo[ok], yo[ok]
            passed[xo] += 1
            now = (passed[xo] > skip) & (passed[xo] <= skip + take)
            xs.append(xo[now])
            ys.append(yo[now])
    none = np.zeros(0, "i8")
    return rows[np.concatenate([none, *xs])], rows[np.concatenate([none, *ys])], rows[passed > skip + take]


PROPOSED = "token long, xd long, xl int, yd long, yl int"


def _answer(f: np.ndarray, x: np.ndarray, y: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    none, rows = np.full(len(more), -1), np.concatenate([x, more])
    cols = {"token": f["token"][rows], "xd": f["d"][rows], "xl": f["line"][rows], "yd": np.concatenate([f["d"][y], none]), "yl": np.concatenate([f["line"][y], none]).astype("i4")}
    return pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in cols.items()})


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Postings of a batch of lines, without those whose lists may be long, and the wide parity of each."""
    size = batch["token"].value_lengths().to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    f = np.zeros(len(row), POSTING)
    f["token"], f["place"] = batch["token"].flatten().to_numpy(), batch["place"].flatten().to_numpy()
    words, flat = batch["parity"].value_lengths().to_numpy(), batch["parity"].flatten().to_numpy().view("u8")
    wide = np.zeros((len(size), 4), "u8")
    wide[np.arange(4) < words[:, None]] = flat
    for c in ("n", "line", "d", "t"):
        f[c] = batch[c].to_numpy()[row]
    f["p"] = np.bitwise_xor.reduce(wide, 1)[row]
    short = f["token"] >= 0
    return f[short], wide[row[short]]


def _packed(lines: DataFrame, buckets: int) -> DataFrame:
    """bucket, postings, wide: the postings of short lists, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            f, wide = (np.concatenate(x) for x in zip(*held))
            bucket = f["token"] % buckets
            order = np.argsort(bucket, kind="stable")
            f, wide, bucket = f[order], wide[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            parts = [(f[a:e], wide[a:e][f["n"][a:e] > WIDE]) for a, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(f)])]
            held.clear()
            return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cuts].astype("i4")), "postings": pa.array([x.tobytes() for x, _ in parts], pa.binary()), "wide": pa.array([w.tobytes() for _, w in parts], pa.binary())})

        for b in batches:
            held.append(_flat(b))
            size += len(held[-1][0])
            if size > PACKED:
                yield packed()
                size = 0
        if size:
            yield packed()

    return lines.mapInArrow(run, "bucket int, postings binary, wide binary")


def _in_buckets(lines: DataFrame, postings: int, skip: int, take: int) -> DataFrame:
    """Proposals of all lines from their short lists."""
    buckets = max(1, -(-postings // BUCKET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []

        def done() -> pa.RecordBatch:
            f = np.frombuffer(b"".join(x for x, _ in held), POSTING)
            wide = np.zeros((len(f), 4), "u8")
            wide[f["n"] > WIDE] = np.frombuffer(b"".join(w for _, w in held), "<u8").reshape(-1, 4)
            return _answer(f, *partners(f, wide, f["token"], None, None, np.ones(len(f), bool), skip, take))

        for batch in batches:
            for bucket, postings, wide in zip(batch["bucket"].to_pylist(), batch["postings"].to_pylist(), batch["wide"].to_pylist()):
                if bucket != now and held:
                    yield done()
                    held = []
                now = bucket
                held.append((postings, wide))
        if held:
            yield done()

    return _packed(lines, buckets).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, PROPOSED)


def _in_rows(rows: DataFrame, skip: int, take: int) -> DataFrame:
    """Proposals from lists that come as rows: token, u, v (pair of chunks), mine, asks, item_group, and a posting's fields with ``parity`` as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done(t: pa.Table) -> pa.RecordBatch:
            f = np.zeros(len(t), POSTING)
            for c in ("token", "n", "place", "line", "d", "t"):
                f[c] = t[c].to_numpy()
            parity = t["parity"].combine_chunks()
            wide = np.zeros((len(t), 4), "u8")
            wide[np.arange(4) < parity.value_lengths().to_numpy()[:, None]] = parity.flatten().to_numpy().view("u8")
            f["p"] = np.bitwise_xor.reduce(wide, 1)
            u, v = t["u"].to_numpy(), t["v"].to_numpy()
            new = np.ones(len(t), bool)
            new[1:] = (f["token"][1:] != f["token"][:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])
            # in a cell of one chunk all are unlike
            mine = np.where(u == v, np.arange(len(t)), -1 - t["mine"].to_numpy().astype("i8"))
            return _answer(f, *partners(f, wide, np.cumsum(new), mine, t["item_group"].to_numpy(), t["asks"].to_numpy(), skip, take))

        for b in batches:
            held.append(b)
            size += len(b)
            if size < LIST:
                continue
            t = pa.Table.from_batches(held)
            # the last list may go on in the next batch
            whole = np.flatnonzero(np.any([k != k[-1] for k in (t[c].to_numpy() for c in ("token", "u", "v"))], 0))
            if len(whole):
                cut = int(whole[-1]) + 1
                yield done(t.slice(0, cut))
                held, size = t.slice(cut).to_batches(), len(t) - cut
        if size:
            yield done(pa.Table.from_batches(held))

    columns = ("token", "u", "v", "mine", "item_group", "asks", "n", "place", "line", "d", "t", "parity")
    dealt = rows.select(*columns).repartition("token", "u", "v").sortWithinPartitions("token", "u", "v")
    return dealt.mapInArrow(run, PROPOSED)


_MARKS: dict[str, np.ndarray] = {}


def _marks(where: str) -> np.ndarray:
    """A table of cells as flags, an array of a fixed size; read once per worker."""
    if where not in _MARKS:
        import pyarrow.dataset as ds

        fs, at = storage.filesystem(where)
        flags = np.zeros(MARKS, bool)
        for b in ds.dataset(at, filesystem=fs, format="parquet").to_batches():
            flags[b["cell"].to_numpy()] = True
        _MARKS.clear()
        _MARKS[where] = flags
    return _MARKS[where]


class Lists:
    """The posting lists of stored items (columns ITEM). Proposals have the columns PROPOSED: y is earlier than x in (d, line); yl < 0: x has more in that list."""

    def __init__(self, items: DataFrame, tmp: storage.Tables):
        self.items = items.select("d", "line", "n", "t", "parity", "token", "place")
        self.postings = items.agg(F.sum(F.size("token"))).first()[0] or 0
        rows = self.items.filter(F.array_min("token") < 0).select("d", "line", "n", "t", "parity", F.inline(F.arrays_zip("token", "place")))
        self.maybe_long = rows.filter("token < 0")
        sizes = self.maybe_long.groupBy("token").count().filter(F.col("count") > 1)
        self.long = tmp.stored(sizes.select("token", F.ceil(F.col("count") / LIST).cast("int").alias("chunks")), "long-lists")

    def _of(self, tokens: DataFrame, tmp: storage.Tables) -> DataFrame:
        """Postings of the tokens' lists, and few others."""
        where = tmp.dir("marks")
        tokens.select(F.pmod("token", F.lit(MARKS)).cast("int").alias("cell")).distinct().write.parquet(where)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags = _marks(where)
            for b in batches:
                size = b["token"].value_lengths().to_numpy()
                token, place = b["token"].flatten().to_numpy(), b["place"].flatten().to_numpy()
                some = np.flatnonzero(flags[token % MARKS])
                row = pa.array(np.repeat(np.arange(len(size)), size)[some])
                cols = {c: b[c].take(row) for c in ("d", "line", "n", "t", "parity")}
                yield pa.RecordBatch.from_pydict(cols | {"token": pa.array(token[some]), "place": pa.array(place[some])})

        return self.items.mapInArrow(run, "d long, line int, n int, t long, parity array<long>, token long, place int")

    def _cut(self, rows: DataFrame) -> DataFrame:
        """Rows under each pair of chunks of their list that they belong to."""
        zero = F.lit(0).cast("int")
        rows = rows.withColumn("mine", F.pmod(F.xxhash64("t"), F.col("chunks")).cast("int")).withColumn("with", F.explode(F.sequence(zero, F.col("chunks") - 1)))
        return rows.withColumn("u", F.least("mine", "with")).withColumn("v", F.greatest("mine", "with"))

    def first(self, take: int = PROPOSALS) -> DataFrame:
        """All items ask all their lists."""
        found = _in_buckets(self.items, self.postings, 0, take)
        if not self.long.limit(1).count():
            return found
        rows = self._cut(self.maybe_long.join(small(self.long), "token"))
        return found.unionByName(_in_rows(rows.withColumn("asks", F.lit(True)).withColumn("item_group", F.monotonically_increasing_id()), 0, take))

    def again(self, wanted: DataFrame, tmp: storage.Tables, skip: int, take: int, groups: DataFrame | None = None) -> DataFrame:
        """The wanted (token, d, line) ask for what follows their first ``skip``. groups: d, item_group; pairs of one group are left out (each that is not named is one)."""
        tokens = tmp.stored(wanted.select("token").distinct().join(self.long, "token", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))), "wanted")
        rows = self._of(tokens, tmp).join(small(tokens), "token").join(small(wanted.withColumn("asks", F.lit(True))), ["token", "d", "line"], "left")
        rows = self._cut(rows.withColumn("asks", F.coalesce("asks", F.lit(False))))
        if groups is None:
            return _in_rows(rows.withColumn("item_group", F.monotonically_increasing_id()), skip, take)
        return _in_rows(rows.join(small(groups), "d", "left").withColumn("item_group", F.coalesce("item_group", "d")), skip, take)


def small(df: DataFrame, numbers: int = 4, each=None) -> DataFrame:
    """df, to be broadcast if its size is within the bound: rows of so many numbers, and ``each`` (a column) more for each row."""
    most = BROADCAST_NUMBERS // numbers
    if df.limit(most + 1).count() > most:
        return df
    return F.broadcast(df) if each is None or (df.agg(F.sum(each)).first()[0] or 0) <= BROADCAST_NUMBERS else df


