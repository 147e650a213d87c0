"""Rules of workspaces as relations: one row for each violation, with its path (FIL15).

Tables, each with ``cluster_key``: merges and groups (entity_id, member_ref), nodes (entity_id, node_id, source_ref), transfers (entity_id, from_node, to_node,
seconds), kept_apart (set_id, member_ref). References are ``raw:``, ``merge:`` or ``group:`` and an id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

KEY = ["cluster_key", "entity_id"]


def _kind(ref: str) -> Column:
    return F.nullif(F.regexp_extract(ref, "^(raw|merge|group):.", 1), F.lit(""))


def violations(merges: DataFrame, groups: DataFrame, nodes: DataFrame, transfers: DataFrame, kept_apart: DataFrame, complete: bool = True) -> DataFrame:
    """cluster_key, path, rule. complete: groups must have a walking time for each pair of their nodes, as resolving asks for.

    No pair is made: n nodes have all times if n (n - 1) / 2 different pairs of them have one. A member that a table repeats counts once.
    """
    said = []

    def say(rows: DataFrame, rule: str, path: Column) -> None:
        said.append(rows.select("cluster_key", path.alias("path"), F.lit(rule).alias("rule")))

    at = lambda table, *more: F.concat(F.lit(f"{table}["), F.col("entity_id" if table != "keep_separate_sets" else "set_id"), F.lit("]"), *more)
    merges, groups = merges.distinct(), groups.distinct()
    for table, rows, key in (("merges", merges, "entity_id"), ("groups", groups, "entity_id"), ("keep_separate_sets", kept_apart.distinct(), "set_id")):
        say(rows.groupBy("cluster_key", key).count().filter("count < 2"), "two members at least", at(table))
        say(rows.filter(_kind("member_ref").isNull()), "no reference", at(table, F.lit("."), F.col("member_ref")))
    say(merges.filter(_kind("member_ref").isin("merge", "group")), "merges have raw members only", at("merges", F.lit("."), F.col("member_ref")))
    say(groups.filter(_kind("member_ref") == "group"), "groups have no group members", at("groups", F.lit("."), F.col("member_ref")))
    doubled = merges.filter(_kind("member_ref") == "raw").groupBy("cluster_key", "member_ref").count().filter("count > 1")
    say(doubled, "one merge for each member", F.concat(F.lit("merges."), "member_ref"))
    merge_ids, group_ids = merges.select(*KEY).distinct(), groups.select(*KEY).distinct()
    say(group_ids.join(merge_ids, KEY, "left_semi"), "entity ids differ", at("groups"))
    known = merge_ids.select("cluster_key", F.concat(F.lit("merge:"), "entity_id").alias("_ref"))
    unknown = lambda rows, ref: rows.filter(_kind(ref) == "merge").withColumn("_ref", F.col(ref)).join(known, ["cluster_key", "_ref"], "left_anti")
    say(unknown(groups, "member_ref"), "known merges", at("groups", F.lit("."), F.col("member_ref")))
    say(group_ids.join(nodes, KEY, "left_anti"), "one node at least", at("groups"))
    node = at("groups", F.lit("."), F.col("node_id"))
    say(unknown(nodes, "source_ref"), "known merges", node)
    say(nodes.join(groups.withColumnRenamed("member_ref", "source_ref"), [*KEY, "source_ref"], "left_anti"), "nodes are of members", node)
    say(nodes.groupBy(*KEY, "node_id").count().filter("count > 1"), "node ids differ", node)
    say(nodes.groupBy(*KEY, "source_ref").count().filter("count > 1"), "nodes' sources differ", at("groups", F.lit("."), F.col("source_ref")))
    times = transfers.withColumn("pair", F.concat_ws("|", F.least("from_node", "to_node"), F.greatest("from_node", "to_node")))
    step = at("groups", F.lit("."), F.col("pair"))
    say(times.filter("from_node = to_node"), "two different nodes", step)
    say(times.filter("seconds is null or seconds < 0"), "seconds from 0 on", step)
    ids = nodes.select(*KEY, "node_id").distinct()
    ends = times.select(*KEY, "pair", F.explode(F.array("from_node", "to_node")).alias("node_id"))
    lost = ends.join(ids, [*KEY, "node_id"], "left_anti").select(*KEY, "pair").distinct()
    say(lost, "known nodes", step)
    say(times.groupBy(*KEY, "pair").count().filter("count > 1"), "one time for each pair", step)
    if complete:
        told = times.filter("from_node <> to_node").select(*KEY, "pair").distinct().join(lost, [*KEY, "pair"], "left_anti").groupBy(*KEY).agg(F.count("*").alias("told"))
        sizes = ids.groupBy(*KEY).agg(F.count("*").alias("n")).join(told, KEY, "left")
        say(sizes.filter(F.coalesce("told", F.lit(0)) * 2 < F.col("n") * (F.col("n") - 1)), "a time for each pair", at("groups"))
    return reduce(DataFrame.unionByName, said)
