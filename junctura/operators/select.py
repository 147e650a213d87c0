"""Rows picked from groups: latest, first, ranked, by key range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ranked(df: DataFrame, by: list, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the row's number within its group (WIN03, WIN05)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_per_group(df: DataFrame, by: list, order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows per group before it shuffles (WIN01, WIN02, WIN05, WIN15, SRT02)."""
    return ranked(df, by, order, "_rank").filter(F.col("_rank") <= n).drop("_rank")


def latest(df: DataFrame, by: list[str], order: list[str], as_of: Column | None = None, date: str | None = None) -> DataFrame:
    """The newest row of each group, nulls oldest; with ``as_of``, of the rows up to that date (WIN01, WIN07-WIN10, JON26).

    One aggregation with partial results instead of a sort: the maximum of a struct that begins with the order.
    """
    rows = df if as_of is None else df.filter(F.col(date) <= as_of)
    rest = [c for c in df.columns if c not in by]
    best = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*by, *(F.col(f"_best.{c}").alias(c) for c in rest)).select(*df.columns)


def max_then_join(df: DataFrame, by: list[str], date: str) -> DataFrame:
    """All rows of each group's newest date (WIN11)."""
    newest = df.groupBy(*by).agg(F.max(date).alias(date))
    return df.join(newest, [*by, date], "left_semi")


def endpoints(df: DataFrame, by: str, seq: str, value: str) -> DataFrame:
    """First and last value along a sequence (WIN12)."""
    return df.groupBy(by).agg(F.min_by(value, seq).alias("first"), F.max_by(value, seq).alias("last"), F.count("*").alias("n"))


def adjacency(df: DataFrame, by: str, seq: str, value: str) -> DataFrame:
    """Consecutive unlike values: from, to (WIN13). Runs of one value count as one."""
    w = Window.partitionBy(by).orderBy(seq)
    changed = df.withColumn("_before", F.lag(value).over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col(value)))
    return changed.select(by, F.col(value).alias("from"), F.lead(value).over(w).alias("to")).filter("to is not null")


def keyset_page(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The next n rows after a key, in its order (SRT05)."""
    return df.filter(F.col(key) > after).orderBy(key).limit(n)


def first_distinct(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows with distinct keys, in order (SRT10)."""
    return top_per_group(df, keys, order).orderBy(*order).limit(k)


def sampled_pairs(df: DataFrame, by: str, seq: str, value: str) -> DataFrame:
    """(first, last), (first, middle), (middle, last) of each sequence, distinct and unlike (SRT12)."""
    path = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).alias("v")))).alias("p")).filter("size(p) >= 2")
    at = lambda i: F.get("p", i)["v"]
    last, mid = F.size("p") - 1, F.floor(F.size("p") / 2).cast("int")
    pairs = F.array(*(F.struct(at(a).alias("from"), at(b).alias("to")) for a, b in ((F.lit(0), last), (F.lit(0), mid), (mid, last))))
    return path.select(F.inline(pairs)).filter(F.col("from") != F.col("to")).distinct()
