"""Near-dedup of documents by Jaccard similarity of their shingle sets, exactly.

A document is the set of its shingles (runs of words, A-Z lower-cased, told apart by 64-bit hashes). Documents are linked where the sets'
Jaccard similarity is 0.8 or more, and one of each component stays. A SimHash can't reach that far: at 0.8, 64 bits differ in about
ten. So SimHash links (blocks and pivots, see simhash) are only the first proposals, which join large groups of copies cheaply; the rest are found
by shared tokens among the rarest of each set (set_join), none of whose filters loses a pair. Each pair is verified on the full sets.

Documents of equal words are one. The others' proposals come in three steps: each one's best partner; then other proposed pairs whose ends are still in
different components; then, from lists in which a document had more partners than it proposed, all pairs of different components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import storage
from ..operators.graph import components
from . import hashing, set_join
from .set_join import small
from .simhash import links, majorities

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _combined(h: np.ndarray, owner: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.bincount(owner, minlength=rows)
    place, words = np.arange(len(h)) - (np.cumsum(m) - m)[owner], m[owner]
    k = np.minimum(size, words)
    out = k.astype("u8")
    with np.errstate(over="ignore"):
        for j in range(size):
            out = np.where(j < k, hashing.mix(out, 0x9E3779B97F4A7C15) + h[np.minimum(np.arange(len(h)) + j, len(h) - 1)], out)
    out = hashing.mix(hashing.mix(out, 0xD6E8FEB86659FD93), 0xC2B2AE3D27D4EB4F)
    whole = place <= words - k
    return out[whole], owner[whole]


def shingles(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row of the first text, number of texts, 64-bit hashes of all shingles and the text (from 0) of each; a text of fewer words is one shingle. Of a long text, hashes of all words are held."""
    for row, parts in groupby(hashing.pieces(texts), lambda x: x[1]):
        found = [(hashing.words(buf.translate(_LOWER)), begins) for buf, _, begins, _ in parts]
        rows = len(found[0][1])
        owner = np.searchsorted(found[0][1], found[0][0][1], side="right") - 1 if len(found) == 1 else np.zeros(sum(len(w[0]) for w, _ in found), "i8")
        yield row, rows, *_combined(np.concatenate([w[0] for w, _ in found]), owner, rows, size)


def _cells(docs: DataFrame, size: int, where: str) -> str:
    return set_join.cell_counts(docs, where, lambda texts: (h for _, _, h, _ in shingles(texts, size)))


def sets_of(docs: DataFrame, size: int, cells: str) -> DataFrame:
    """Documents as set_join's items, with tokens of 63 bits and the SimHash of the set (fingerprint). Documents without words share a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades = set_join.rarity(cells)
        for b in batches:
            ids, texts = b["d"].to_numpy(), b["text"].cast(pa.large_binary())
            for row, rows, h, owner in shingles(b["text"], size):
                digests = [hashlib.blake2b(b" ".join(texts[row + k].as_py().translate(_LOWER).split()), digest_size=16).digest() for k in range(rows)]
                t = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                n, parity, size_ = np.zeros(rows, "i8"), np.zeros((rows, 4), "u8"), np.zeros(rows, "i8")
                token, place, prints = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(rows, "i8")
                if len(h):
                    number, m, bits, offsets, token, place = set_join.sets(h, owner, grades, 63)
                    n[number], parity[number], size_[number] = m, bits, np.diff(offsets)
                    prints = majorities(h, owner, rows)
                cols = {"d": pa.array(ids[row : row + rows]), "line": pa.array(np.zeros(rows, "i4")), "n": pa.array(n.astype("i4")), "t": pa.array(t[:, 0].copy()), "t2": pa.array(t[:, 1].copy())}
                items = set_join.item_columns(np.ones(rows, bool), n, parity, np.concatenate([[0], np.cumsum(size_)]), token, place)
                yield pa.RecordBatch.from_pydict(cols | items | {"fingerprint": pa.array(prints)})

    return docs.mapInArrow(run, set_join.ITEM + ", fingerprint long")


def _verified(docs: DataFrame, pairs: DataFrame, size: int, tmp: storage.Tables) -> DataFrame:
    """a, b of the pairs (x, y) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, rows, h, owner in shingles(b["text"], size):
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                at = np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=rows))])
                yield pa.RecordBatch.from_pydict({"d": b["d"].slice(row, rows), "tokens": pa.ListArray.from_arrays(pa.array(at.astype("i4")), pa.array(h[new].view("i8")))})

    with storage.tables(docs.sparkSession) as inner:
        pairs = inner.stored(pairs, "pairs")
        wanted = pairs.select(F.col("x").alias("d")).unionByName(pairs.select(F.col("y").alias("d"))).distinct()
        sets = inner.stored(docs.join(small(wanted, 1), "d").select("d", "text").mapInArrow(run, "d long, tokens array<long>"), "shingle-sets")
        met = pairs.join(sets.select(F.col("d").alias("x"), F.col("tokens").alias("xt")), "x").join(sets.select(F.col("d").alias("y"), F.col("tokens").alias("yt")), "y")
        both = F.size(F.array_intersect("xt", "yt"))
        p, q = set_join.SIMILARITY
        return tmp.stored(met.filter(both * q >= (F.size("xt") + F.size("yt") - both) * p).select(F.col("x").alias("a"), F.col("y").alias("b")), "similar")


def _between(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """The pairs (x, y) whose ends are in different components (linked: node, component)."""
    of = lambda c: small(linked.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part")), 2)
    return pairs.join(of("x"), "x", "left").join(of("y"), "y", "left").filter(F.coalesce("x_part", "x") != F.coalesce("y_part", "y")).select("x", "y")


def later_copies(docs: DataFrame, size: int) -> DataFrame:
    """d of the documents (d unique, text) that are not the smallest of their component."""
    docs = docs.select("d", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with storage.tables(docs.sparkSession) as tmp:
        sets = tmp.stored(sets_of(docs, size, _cells(docs, size, tmp.dir("cells"))), "sets")
        equal = sets.groupBy("t", "t2").agg(F.min("d").alias("node"), F.count("*").alias("n")).filter("n > 1").select("t", "t2", "node")
        twins = tmp.stored(sets.select("d", "t", "t2").join(small(tmp.stored(equal, "equal"), 3), ["t", "t2"]).filter("d <> node").select("d", "node"), "twins")
        reps = sets.join(small(twins.select("d"), 1), "d", "left_anti")
        classes = tmp.stored(reps.filter("n > 0").groupBy("fingerprint").agg(F.min("d").alias("node")), "classes")
        near = tmp.stored(links(classes.select("node", "fingerprint"), tmp).select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")), "near")
        # proposals of copies are those of their first
        lists = set_join.Lists(reps.drop("fingerprint"), tmp)
        found = tmp.stored(lists.first(), "proposals")
        pairs = tmp.stored(found.filter("yl >= 0").groupBy(F.col("xd").alias("x"), F.col("yd").alias("y")).agg(F.count("*").alias("lists")), "proposed")
        best = pairs.groupBy("x").agg(F.max_by("y", F.struct("lists", "y")).alias("y")).unionByName(near).distinct()
        edges = _verified(docs, best, size, tmp)
        linked = tmp.stored(components(edges), "linked")
        others = tmp.stored(_between(pairs.select("x", "y").join(best, ["x", "y"], "left_anti"), linked), "others")
        if others.limit(1).count():
            edges = edges.unionByName(_verified(docs, others, size, tmp))
            linked = tmp.stored(components(edges), "linked")
        more = tmp.stored(found.filter("yl < 0").select("token", F.col("xd").alias("d"), F.col("xl").alias("line")).distinct(), "more")
        if more.limit(1).count():
            groups = linked.select(F.col("node").alias("d"), F.col("component").alias("item_group"))
            rest = lists.again(more, tmp, 0, 1 << 40, groups).filter("yl >= 0").select(F.col("xd").alias("x"), F.col("yd").alias("y")).distinct()
            rest = tmp.stored(rest.join(pairs.select("x", "y"), ["x", "y"], "left_anti"), "rest")
            if rest.limit(1).count():
                linked = tmp.stored(components(edges.unionByName(_verified(docs, rest, size, tmp))), "linked")
        moved = linked.filter("node <> component").select(F.col("node").alias("d"))
        return storage.stored(moved.unionByName(twins.select("d")), "later")


def keep_first(docs: DataFrame, size: int = 5) -> DataFrame:
    """docs with one row of each component: the one with the smallest (doc_id, text); null doc_ids come first. Documents without words are one."""
    key = storage.free_name("_number", docs)
    rows = storage.numbered(docs, key)
    later = later_copies(rows.select(F.col(key).alias("d"), "text"), size).withColumnRenamed("d", key)
    return rows.join(small(later, 1), key, "left_anti").select(*(f"`{c}`" for c in docs.columns))
