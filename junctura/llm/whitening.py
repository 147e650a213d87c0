"""Whitening of embeddings: exact integer scatter by bit slices, eigenvectors, projections.

Entries become integers, floor(64 c) + 1000000. A block of distinct vectors is shifted by its least entry in each dimension and cut
into bit planes, one bit a row, 64 rows a word. The number of common bits of two planes, weighted by both places, adds up to the
exact sum of products of two dimensions. Tasks send one sum for each pair of dimensions, Spark adds them as decimals, and the
driver, which holds no more than dimensions x dimensions numbers, centres them as integers before eigh sees them.

Vectors that are null, empty or hold null, NaN or infinite entries are left out, as are those of another length than most have
(of equally frequent lengths the longer). Repeated rows each get their result; a vector counts once in the fit. Directions of no variance
(eigenvalue up to 1e-12 of the first) have no whitened value and so no row. An entry of 2^56 or more is refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import storage

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Rows whose planes are held at a time: 64 words a plane.
BLOCK = 4096
#: An eigenvalue up to this part of the first is no direction.
NOTHING = 1e-12
LIMIT = float(1 << 56)


@dataclass(frozen=True)
class Fit:
    """Of n distinct vectors: sums of their entries, eigenvalues and unit eigenvectors (columns), falling; trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integers(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector counts, and ``x``, its entries as integers."""
    c = F.col(vector)
    sound = c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf"))), F.lit(False))
    sizes = table.filter(sound).groupBy(F.size(c).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    large = F.raise_error(F.lit("an entry of 2^56 or more"))
    whole = F.transform(c, lambda v: F.when(F.abs(v.cast("double")) < LIMIT, F.floor(v.cast("double") * SCALE) + OFFSET).otherwise(large.cast("long")))
    return table.filter(sound & (F.size(c) == (sizes[0].size if sizes else 0))).withColumn("x", whole)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("i8")
    return flat.reshape(len(column), -1)


def _planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of columns (no entry is negative) as words across rows, and the columns that have them: (planes, words), (2, planes) of column and place."""
    places = [(d, b) for d, most in enumerate(y.max(axis=0).tolist()) for b in range(int(most).bit_length())]
    out = np.zeros((len(places), -(-len(y) // 64) * 8), "u1")
    for k, (d, b) in enumerate(places):
        bits = np.packbits((y[:, d] >> b).astype("u1") & 1, bitorder="little")
        out[k, : len(bits)] = bits
    return out.view("<u8"), np.array(places, "i8").reshape(-1, 2).T


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of entries and of products of entries of a block of rows, as Python's integers."""
    n, dims = x.shape
    low = x.min(axis=0)
    planes, (column, place) = _planes(x - low)
    products = np.zeros((dims, dims), object)
    width = int(place.max(initial=0)) + 1
    kind = "i8" if 2 * width + n.bit_length() <= 62 else object
    weights = np.array([1 << b for b in place.tolist()], object).astype(kind)
    starts = np.flatnonzero(np.diff(column, prepend=-1))
    for k in range(len(planes)):
        common = np.bitwise_count(planes & planes[k]).sum(axis=1, dtype="i8").astype(kind)
        products[column[k], column[starts]] += (np.add.reduceat(common * weights, starts) * weights[k]).astype(object)
    sums = (x - low).astype(object).sum(axis=0)
    low = low.astype(object)
    # of y = x - low: sum x x' = sum y y' + low sum y' + sum y low' + n low low'
    products += np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)
    return sums + n * low, products


def _scatters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums, products = 0, 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            x = _matrix(batch.column("x").slice(at, BLOCK))
            s, p = scatter(x)
            n, sums, products = n + len(x), sums + s, products + p
    if n:
        i, j = np.triu_indices(len(sums))
        ids = [(-1, -1), *((-1, d) for d in range(len(sums))), *zip(i.tolist(), j.tolist(), strict=True)]
        values = [n, *sums.tolist(), *products[i, j].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in ids], "i4"), pa.array([b for _, b in ids], "i4"), pa.array([str(v) for v in values])], ["i", "j", "value"])


def fit(distinct: DataFrame) -> Fit | None:
    """Eigenvectors of the covariance of distinct rows of ``x``; None without rows. The driver gets a number for each pair of dimensions."""
    sent = distinct.select("x").mapInArrow(_scatters, "i int, j int, value string")
    got = {(r.i, r.j): int(r.value) for r in sent.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    if not got:
        return None
    n = got[-1, -1]
    dims = max(j for _, j in got) + 1
    sums = tuple(got[-1, d] for d in range(dims))
    v = np.empty((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            v[i, j] = v[j, i] = (n * got[i, j] - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:COMPONENTS], vectors[:, ::-1][:, :COMPONENTS]
    some = values > NOTHING * max(values[0], 0.0)
    values, vectors = values[some], vectors[:, some]
    # of the two signs the one by which the largest entry is positive
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return Fit(n, sums, values, vectors * signs, float(np.trace(v)))


def _centred(x: np.ndarray, found: Fit) -> np.ndarray:
    """n x - S, exact."""
    most = max(abs(int(x.max())), abs(int(x.min()))) * found.n + max(abs(s) for s in found.sums)
    kind = "i8" if most < 1 << 62 else object
    return x.astype(kind) * found.n - np.array(found.sums, kind)


def _whitened(centred: np.ndarray, found: Fit) -> np.ndarray:
    return (centred / found.n).astype("f8") @ found.vectors / np.sqrt(found.values)


def _deviation(centred: np.ndarray) -> list[int]:
    most = int(np.abs(centred).max())
    wide = centred if most * most * centred.shape[1] < 1 << 63 else centred.astype(object)
    return (wide * wide).sum(axis=1).tolist()


def identity_error(distinct: DataFrame, found: Fit) -> float:
    """Largest entry, without its sign, of the whitened rows' covariance minus the identity, worked out from all rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(found.values),) * 2)
        for batch in batches:
            if batch.num_rows:
                w = _whitened(_centred(_matrix(batch.column("x")), found), found)
                total += w.T @ w
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, "i4"), pa.array(j, "i4"), pa.array(total[i, j])], ["i", "j", "value"])

    rows = distinct.select("x").mapInArrow(sums, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    return max(abs(r.value / found.n - (r.i == r.j)) for r in rows)


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector that counts and each component: key, component, n, deviation decimal(38,0), whitened, explained, identity_error.

    The fit's tables are removed before this returns; the rows themselves are computed when they are asked for.
    """
    spark = table.sparkSession
    rows = integers(table.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector").select("key", "x")
    with storage.tables(spark) as held:
        distinct = held.stored(rows.select("x").distinct(), "distinct-vectors")
        found = fit(distinct)
        error = identity_error(distinct, found) if found and len(found.values) else 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(found.values) if found else 0
        for batch in batches:
            if batch.num_rows and k:
                centred = _centred(_matrix(batch.column("x")), found)
                r = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(np.repeat(np.arange(r), k))), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), r)), pa.array(np.full(r * k, found.n, "i8")),
                        pa.array([str(d) for d in _deviation(centred)]).take(pa.array(np.repeat(np.arange(r), k))), pa.array(_whitened(centred, found).ravel()), pa.array(np.tile(found.values / found.trace, r)), pa.array(np.full(r * k, error)),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(project, f"key {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")).withColumnRenamed("key", key)
