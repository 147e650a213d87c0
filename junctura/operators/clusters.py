"""Lists and documents of clusters (PIP17), with what each candidate's mappings say (JON18)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

SEVERITIES = ("high", "medium")


def provenance(candidates: DataFrame, mappings: DataFrame) -> DataFrame:
    """candidates (station_id, ...) with sorted distinct active and historical source_ids and refs of their mappings; all four are empty where there are none.

    A lateral aggregate, left joined ON true: Spark makes one join and one aggregation of it.
    """
    there = lambda c, active: F.array_sort(F.collect_set(F.when(F.col("is_active") == active, F.col(c))))
    # a name that mappings don't have, as theirs would win; select and not agg, which wants its input resolved at once
    told = mappings.where(F.col("station_id") == F.col("_candidate").outer()).select(
        there("source_id", True).alias("active_source_ids"), there("ref", True).alias("active_refs"), there("source_id", False).alias("historical_source_ids"), there("ref", False).alias("historical_refs")
    )
    return candidates.withColumn("_candidate", F.col("station_id")).lateralJoin(told, how="left").drop("_candidate")


def cluster_list(clusters: DataFrame, workspaces: DataFrame, candidates: DataFrame, status: str | None = None, scope_tag: str | None = None, country: str | None = None, limit: int = 50) -> DataFrame:
    """The first clusters by severity, newest change, key; with effective_status, has_workspace, workspace_version and their candidates by rank.

    clusters: cluster_key, status, severity, scope_tag, country_tags, updated_at, ...; workspaces: cluster_key, version; candidates: cluster_key, station_id, rank, display_name, ...
    A cluster that is open and has a workspace is in review. The limit is 1 to 300; only clusters within it meet candidates.
    """
    rows = clusters
    for value, test in ((status, lambda v: F.col("status") == v), (scope_tag, lambda v: F.col("scope_tag") == v), (country, lambda v: F.array_contains("country_tags", v))):
        if value:
            rows = rows.filter(test(value))
    joined = rows.join(workspaces.select("cluster_key", F.col("version").alias("workspace_version"), F.lit(True).alias("has_workspace")), "cluster_key", "left").withColumn("has_workspace", F.coalesce("has_workspace", F.lit(False)))
    effective = F.when(F.col("has_workspace") & (F.col("status") == "open"), "in_review").otherwise(F.col("status"))
    weight = F.when(F.col("severity") == SEVERITIES[0], 1).when(F.col("severity") == SEVERITIES[1], 2).otherwise(3)
    first = joined.withColumn("effective_status", effective).orderBy(weight, F.desc("updated_at"), "cluster_key").limit(max(1, min(300, limit)))
    body = [c for c in candidates.columns if c not in ("cluster_key", "rank", "station_id")]
    of = candidates.join(F.broadcast(first.select("cluster_key")), "cluster_key", "left_semi").groupBy("cluster_key").agg(F.array_sort(F.collect_list(F.struct("rank", "station_id", *body))).alias("candidates"))
    return first.join(of, "cluster_key", "left").withColumn("candidates", F.coalesce("candidates", F.array()))


def cluster_documents(clusters: DataFrame, **parts: tuple[DataFrame, list[str]]) -> DataFrame:
    """clusters with an array column for each part: its rows of the cluster as structs, in the order of the columns named.

    All parts travel in one tagged union and meet their cluster in one aggregation, so n parts cost one shuffle and not n joins. A document holds
    what its cluster has; rows of unknown clusters are left out.
    """
    kinds = {}
    tagged = [clusters.select("cluster_key", F.struct(*clusters.columns).alias("_cluster"))]
    for name, (rows, order) in parts.items():
        columns = [*order, *(c for c in rows.columns if c not in (*order, "cluster_key"))]
        tagged.append(rows.select("cluster_key", F.struct(*columns).alias(name)))
        kinds[name] = tagged[-1].schema[name].dataType
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    made = both.groupBy("cluster_key").agg(F.first("_cluster", True).alias("_cluster"), *(F.array_sort(F.collect_list(n)).alias(n) for n in parts))
    return made.filter("_cluster is not null").select("_cluster.*", *parts)
