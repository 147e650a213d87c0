"""Runs compared with the truth, and trailing-window figures (PIP19, AGG20-AGG23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def nearest_rank(values: Column, p: float) -> Column:
    """The ceil(p n)-th smallest of an array, null for none (AGG21)."""
    v = F.array_sort(F.array_compact(values))
    return F.when(F.size(v) > 0, F.element_at(v, F.greatest(F.lit(1), F.ceil(F.size(v) * p).cast("int"))))


def floor_rank(values: Column, p: float) -> Column:
    """The element at max(0, floor(p n) - 1) (AGG20)."""
    v = F.array_sort(F.array_compact(values))
    return F.when(F.size(v) > 0, F.get(v, F.greatest(F.lit(0), F.floor(F.size(v) * p).cast("int") - 1)))


def rounded_rank(values: Column, p: float) -> Column:
    """The element at round((n - 1) p), halves to even (AGG22)."""
    v = F.array_sort(F.array_compact(values))
    return F.when(F.size(v) > 0, F.get(v, F.bround((F.size(v) - 1) * F.lit(p)).cast("int")))


def run_metrics(items: DataFrame, by: str) -> DataFrame:
    """items: verdict_exact, false_merge, false_dismiss (booleans), latency, tokens, cost. Rates to four places, nearest ranks, sums.

    percentile_disc takes the nearest rank from a merged histogram of values; no run is collected into one array.
    """
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4).alias(f"{c}_rate")
    disc = lambda p, n: F.expr(f"percentile_disc({p}) within group (order by latency)").alias(n)
    return items.groupBy(by).agg(F.count("*").alias("items"), rate("verdict_exact"), rate("false_merge"), rate("false_dismiss"), disc(0.5, "p50"), disc(0.95, "p95"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))


def pairwise_agreement(truth: DataFrame, found: DataFrame) -> DataFrame:
    """truth and found: case_id, a, b, relation. Per case the share of pairs with equal relations, over pairs that either has."""
    t = truth.select("case_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("relation").alias("t"), F.lit(None).cast("string").alias("f"))
    f = found.select("case_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(None).cast("string").alias("t"), F.col("relation").alias("f"))
    pairs = t.unionByName(f).groupBy("case_id", "a", "b").agg(F.max("t").alias("t"), F.max("f").alias("f"))
    return pairs.groupBy("case_id").agg(F.count("*").alias("pairs"), F.round(F.avg(F.coalesce(F.col("t") == F.col("f"), F.lit(False)).cast("double")), 4).alias("agreement"))


def kpis(jobs: DataFrame, since: Column, by: list[str]) -> DataFrame:
    """jobs: status, started_at, ended_at. Totals, mean and p95 seconds and the share of failures since a time (AGG20)."""
    seconds = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6
    recent = jobs.filter(F.col("started_at") >= since).withColumn("seconds", seconds)
    return recent.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg("seconds"), 3).alias("mean_seconds"), F.round(floor_rank(F.collect_list("seconds"), 0.95), 3).alias("p95_seconds"), F.round(100 * F.avg((F.col("status") == "failed").cast("double")), 2).alias("failed_percent"))


def heuristic_verdict(pairs: DataFrame) -> DataFrame:
    """pairs: cluster_key, ratio. Merge above a mean of .85, review above .6, else keep separate; a cluster without pairs merges."""
    mean = F.avg("ratio")
    return pairs.groupBy("cluster_key").agg(F.when(F.count("ratio") == 0, "merge").when(mean > 0.85, "merge").when(mean > 0.6, "needs_review").otherwise("keep_separate").alias("verdict"), F.round(F.coalesce(mean, F.lit(1.0)), 4).alias("confidence"))
