"""Best-fit packing with certified bin counts.

Items are dealt evenly to partitions. Each partition packs its items best-fit decreasing and compares its bin
count with a lower bound from dual-feasible functions; where both agree, the count is certified as least possible. Partitions
with a gap give the items of their unfilled bins to a pool, every other partition those of its emptiest bin. The pool
is dealt anew, to fewer partitions, and packed again, until the whole meets the bound over all lengths or a
round saves nothing (there is no other limit). A round is kept only if it saves bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import storage
from . import tokens

CAPACITY = 1024
#: Items of one partition; what a task holds in memory follows from it.
ITEMS = 40_000


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins that items of these lengths need at least, by two families of dual-feasible functions.

    For a threshold e: lengths over capacity - e count as a whole bin, those under e as nothing. For k: a length x
    counts as x where (k + 1) x is a multiple of the capacity, else as floor((k + 1) x / capacity) capacity / k. Both compose.
    """
    x, n = lengths.astype("i8"), counts.astype("i8")
    if not n.sum():
        return 0
    best = -(-int((x * n).sum()) // capacity)
    for e in sorted({int(v) for v in x if 2 * v <= capacity} | {0}):
        y = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        best = max(best, -(-int((y * n).sum()) // capacity))
        if e and e % 16 == 0 or e == 0:
            for k in range(1, 21):
                whole = (k + 1) * y % capacity == 0
                total = int((np.where(whole, k * y, (k + 1) * y // capacity * capacity) * n).sum())
                best = max(best, -(-total // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins. Ties keep the order given."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    with_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps, n = 0, 0  # bit g of gaps: some bin has g places left
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = gaps >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            b = with_gap[gap].pop()
            if not with_gap[gap]:
                gaps &= ~(1 << gap)
        else:
            gap, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - gap
        with_gap[gap - size].append(b)
        gaps |= 1 << (gap - size)
    return bins, offsets, n


def _packed(items: DataFrame, capacity: int, partitions: int, base: int) -> DataFrame:
    """items: uid, length. Adds sequence_id, offset, fill (of the bin), certified and weakest (its partition's emptiest bin)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid", ignore_index=True)
        x = group["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(x, capacity)
        sizes, counts = np.unique(x, return_counts=True)
        fill = np.bincount(bins, weights=x, minlength=n).astype("i8")
        return pd.DataFrame(
            {
                "uid": group["uid"],
                "length": x,
                "sequence_id": base + group["g"] * 2 * ITEMS * 4 + bins,
                "offset": offsets,
                "fill": fill[bins],
                "certified": n == lower_bound(sizes, counts, capacity),
                "weakest": bins == int(fill.argmin()),
            }
        )

    dealt = items.select("uid", "length", F.pmod(F.xxhash64(F.col("uid"), F.lit(base)), F.lit(partitions)).alias("g"))
    return dealt.groupBy("g").applyInPandas(run, "uid long, length long, sequence_id long, offset long, fill long, certified boolean, weakest boolean")


def pack(items: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, dict]:
    """Pack items (uid long, unique; length 1 to capacity) into as few sequences as it can.

    Returns uid, sequence_id, offset, certified (whether the partition that the sequence is from has the fewest bins that its items can have) and
    a report: bins, the lower bound over all lengths, whether that certifies the count, passes over the pool. Offsets within a sequence are gapless from 0. An empty table packs into nothing.
    """
    spark = items.sparkSession
    lengths = items.groupBy("length").count().collect()  # at most ``capacity`` rows
    report = {"items": sum(r["count"] for r in lengths), "bound": lower_bound(np.array([r["length"] for r in lengths]), np.array([r["count"] for r in lengths]), capacity), "rounds": 0}
    settled: list[DataFrame] = []
    n_settled, base, n = 0, 0, report["items"]
    now = storage.stored(_packed(items, capacity, max(1, -(-n // ITEMS)), base), "packing")
    live = _bins(now)
    while True:
        report["rounds"] += 1
        if n_settled + live <= report["bound"]:
            break
        gives = (~F.col("certified") & (F.col("fill") < capacity)) | (F.col("weakest") & (F.col("fill") < capacity))
        m, before = now.filter(gives).agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        if before < 2:
            break
        base += 1 << 48
        again = storage.stored(_packed(now.filter(gives).select("uid", "length"), capacity, max(1, -(-m // ITEMS)), base), "packing")
        after = _bins(again)
        if after >= before:
            break
        settled.append(now.filter(~gives))
        n_settled, now, live = n_settled + live - before, again, after
    bins = n_settled + live
    out = now
    for d in settled:
        out = out.unionByName(d)
    report |= {"bins": bins, "certified": bins == report["bound"]}
    return out.select("uid", "sequence_id", "offset", "certified"), report


def _bins(packed: DataFrame) -> int:
    """Each bin has exactly one item at offset 0."""
    return packed.filter("offset = 0").count()


def cut(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int | None = tokens.END_ID, keep_ids: bool = False) -> DataFrame:
    """Encode documents (doc_id, text; other columns are ignored) and cut those over ``capacity`` tokens into pieces.

    The first piece takes what is over, so all others are full. Null texts count as empty and give one piece with the end
    id. Rows that repeat a doc_id give pieces each. Columns: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian
    unsigned 32-bit).
    """
    path = tokenizer or tokens.default_tokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            for doc_id, ids in zip(b["doc_id"], tokens.encoded(path, b["text"], end_id)):
                n = len(ids) // 4
                a = 0
                for k, end in enumerate(range(n % capacity or capacity, n + 1, capacity)):
                    part = ids[4 * a : 4 * end]
                    doc.append(doc_id), piece.append(k), start.append(a), length.append(end - a), crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
                    a = end
            out = pd.DataFrame({"doc_id": pd.array(doc, "Int64"), "piece": piece, "start": start, "length": length, "ids_crc32": crc})
            yield out.assign(ids=kept) if keep_ids else out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int | None = tokens.END_ID, keep_ids: bool = False) -> tuple[DataFrame, dict]:
    """Pieces of all documents with sequence_id, offset and certified, and pack()'s report; full pieces are sequences of their own."""
    pieces = storage.stored(cut(docs, tokenizer, capacity, end_id, keep_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed, report = pack(pieces.filter(F.col("length") < capacity).select("uid", "length"), capacity)
    full = pieces.filter(F.col("length") == capacity)
    whole = full.select("*", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    rest = pieces.filter(F.col("length") < capacity).join(placed, "uid")
    return rest.unionByName(whole).drop("uid"), report | {"full": full.count()}


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from pack_documents(..., keep_ids=True); a sequence has at most ``capacity`` pieces."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"sequence_id": b["sequence_id"], "ids": [np.frombuffer(b"".join(p["ids"] for p in ps), "<u4").astype("i8") for ps in b["parts"]]})

    return parts.mapInPandas(run, "sequence_id long, ids array<long>")
