"""SimHash near-dedup with pivot distance tables.

Equal fingerprints are one class. Two fingerprints at most k bits apart agree on at least B - k of B blocks of their
bits, so each class is listed under every choice of B - k blocks with their bits, and only classes of a list meet.
In a list, a table holds each fingerprint's Hamming distances to a row of reference fingerprints (pivots); by the triangle
inequality a pair whose distances to some pivot differ by more than k is discarded, the rest are verified bit by
bit. A list gives only the edges that join its parts, a forest, and not all its pairs. Long lists are cut into
chunks and pairs of chunks, which go to tasks of their own.

Pivots alone can't choose the pairs: a random pair of 64-bit fingerprints passes a pivot in over half of all cases, so
cells by pivot distances would hold nearly everything. Hence the lists by blocks in front, which lose no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .. import storage
from ..operators.graph import components

BLANK = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS, LINK, PIVOTS = 64, 4, 24
#: Members of a list that one task compares at once; longer lists are cut.
CHUNK = 2_000
#: Rows (one number each) that are broadcast at most.
BROADCAST_ROWS = 500_000


def majorities(h: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """The 64 bits that are set in over half of each owner's hashes (owners ascending); zero for none."""
    n = np.bincount(owner, minlength=rows)
    counts = np.zeros((rows, 64), "i8")
    for a in range(0, len(h), 1 << 17):  # bits of so many hashes at once
        part = h[a : a + (1 << 17)]
        own = owner[a : a + len(part)]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        counts[own[starts]] += np.add.reduceat(np.unpackbits(part.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little"), starts, axis=0, dtype="i4")
    return ((2 * counts > n[:, None]) << np.arange(64)).sum(1).astype("i8")


def majority(hashes: pd.Series) -> pd.Series:
    """The same of each row's array."""
    n = np.fromiter((len(x) for x in hashes), "i8", len(hashes))
    flat = np.concatenate([np.zeros(0, "i8"), *hashes]).astype("i8").view("u8")
    return pd.Series(majorities(flat, np.repeat(np.arange(len(n)), n), len(n)))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (64 bits, as a long) of documents (doc_id, text; other columns are ignored).

    A-Z is lower-cased; words are runs without white space; a text of fewer words is one shingle; one without words (null, empty) has
    fingerprint zero. A shingle that repeats counts as often as it stands there.
    """
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    w = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.filter(F.split(text, BLANK + "+"), lambda x: x != "").alias("w"))
    joined = lambda i: F.xxhash64(F.concat_ws(" ", *(F.get("w", i + k) for k in range(shingle))))
    hashes = (
        F.when(F.size("w") == 0, F.array().cast("array<long>"))
        .when(F.size("w") < shingle, F.array(F.xxhash64(F.concat_ws(" ", F.col("w")))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size("w") - shingle), joined))
    )
    return w.select("doc_id", pandas_udf(majority, "long")(hashes).alias("fingerprint"))


def blocks_for(classes: int) -> int:
    """Blocks so that lists of unlike fingerprints stay short: B - 4 of B blocks are to have about as many values as there are classes."""
    return next((b for b in (6, 7, 8, 10) if 2 ** (BITS * (b - LINK) / b) >= 4 * classes), 12)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints, far from each other: zero, and seeded random ones."""
    return np.concatenate([np.zeros(1, "u8"), np.random.default_rng(64).integers(0, 1 << 64, n - 1, dtype="u8")])


def forest(prints: np.ndarray, ids: np.ndarray, link: int, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join what is linked by at most ``link`` bits; with ``other`` (a mask), only pairs of unlike masks are looked at.

    Rows are taken in the order of one pivot's distances; each is compared with those at most ``link`` further on.
    """
    table = _popcount(prints[:, None] ^ pivots()[None, :]).astype("i1")
    spread = int(table.std(0).argmax())
    order = np.argsort(table[:, spread], kind="stable")
    table, prints, ids = table[order], prints[order], ids[order]
    side = None if other is None else other[order]
    ends = np.searchsorted(table[:, spread], table[:, spread] + link, side="right")
    parent = list(range(len(prints)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in range(len(prints) - 1):
        a, b = i + 1, int(ends[i])
        if a >= b:
            continue
        near = np.arange(a, b) if side is None else a + np.flatnonzero(side[a:b] != side[i])
        near = near[(np.abs(table[near] - table[i]) <= link).all(1)]  # the largest coordinate difference
        for j in near[_popcount(prints[near] ^ prints[i]) <= link].tolist():
            p, q = root(i), root(j)
            if p != q:
                parent[max(p, q)] = min(p, q)
                edges.append((int(ids[i]), int(ids[j])))
    return edges


def links(classes: DataFrame, tmp: storage.Tables, link: int = LINK, bits: int = BITS) -> DataFrame:
    """Edges a, b between class nodes that connect exactly what links of at most ``link`` bits connect. classes: node, fingerprint (distinct)."""
    b = blocks_for(classes.count())
    borders = [round(bits * k / b) for k in range(b + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(borders, borders[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = [signed(sum(masks[k] for k in c)) for c in combinations(range(b), b - link)]
    keyed = F.array(*(F.struct(F.lit(k).cast("int").alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(chosen)))
    listed = classes.select("node", "fingerprint", F.explode(keyed).alias("key")).select("node", "fingerprint", "key.choice", "key.bits")
    # long lists first: they are few, as each has over CHUNK members
    sizes = listed.groupBy("choice", "bits").count()
    long = tmp.stored(sizes.filter(F.col("count") > CHUNK).select("choice", "bits", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "long-lists")
    some = long.limit(1).count() > 0
    marked = listed.join(long, ["choice", "bits"], "left") if some else listed.withColumn("chunks", F.lit(None).cast("int"))
    short = marked.filter("chunks is null").groupBy("choice", "bits").agg(F.collect_list(F.struct("node", "fingerprint")).alias("members")).filter("size(members) > 1").select("members")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            edges = []
            for m in batch["members"]:
                prints = np.array([x["fingerprint"] for x in m], "i8").view("u8")
                if len(m) == 2:  # most lists
                    if int(prints[0] ^ prints[1]).bit_count() <= link:
                        edges.append((m[0]["node"], m[1]["node"]))
                else:
                    edges += forest(prints, np.array([x["node"] for x in m], "i8"), link)
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="i8")

    out = short.mapInPandas(run, "a long, b long")
    if not some:
        return out.distinct()

    def cell(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["mine", "node"])
        two = group["u"].iloc[0] != group["v"].iloc[0]
        edges = forest(group["fingerprint"].to_numpy("i8").view("u8"), group["node"].to_numpy("i8"), link, group["mine"].to_numpy() if two else None)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="i8")

    mine = marked.filter("chunks is not null").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    met = mine.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = met.select("choice", "bits", "node", "fingerprint", "mine", F.least("mine", "with").alias("u"), F.greatest("mine", "with").alias("v"))
    return out.unionByName(cells.groupBy("choice", "bits", "u", "v").applyInPandas(cell, "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, link: int = LINK) -> DataFrame:
    """doc_id, fingerprint (long) and component_id, the smallest doc_id that links of at most ``link`` bits reach.

    Documents without words share fingerprint zero and are linked like all others. Rows with a null doc_id get their class's
    component, or null where no linked row has an id. Rows that repeat a doc_id stay.
    """
    prints = storage.stored(fingerprints(docs, shingle), "fingerprints")
    with storage.tables(docs.sparkSession) as tmp:
        classes = tmp.stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "classes")
        linked = components(links(classes.select("node", "fingerprint"), tmp, link))
        of_class = classes.join(linked, "node", "left").select("fingerprint", "least", F.coalesce("component", "node").alias("component"))
        least = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
        named = storage.stored(of_class.join(least, "component").select("fingerprint", "component_id"), "components")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, link: int = LINK) -> DataFrame:
    """docs with one row of each component: the one with the smallest (doc_id, text); null doc_ids come first."""
    key = storage.free_name("_number", docs)
    rows = storage.numbered(docs, key)
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), shingle, link)
    later = storage.stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(key)), "later")
    small = later.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(later) if small else later, key, "left_anti").select(*(f"`{c}`" for c in docs.columns))
