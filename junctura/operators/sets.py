"""Set operations and table maintenance: each returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def symmetrized(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges in both directions (SET03)."""
    back = edges.withColumns({a: F.col(b), b: F.col(a)})
    return edges.unionByName(back)


def unpivot(df: DataFrame, keys: list[str], rows: list[dict[str, Column]]) -> DataFrame:
    """One pass that gives a row for each of ``rows`` (SET05)."""
    return df.select(*keys, F.inline(F.array(*(F.struct(*(c.alias(n) for n, c in r.items())) for r in rows))))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """First wins: old rows, and new ones with keys that are not there (SET07, SET12)."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """New rows replace old ones with their keys; columns in ``keep`` stay as they were (SET08)."""
    kept = old.join(new.select(*keys), keys, "left_anti")
    if not keep:
        return kept.unionByName(new)
    was = old.select(*keys, *(F.col(c).alias(f"_was_{c}") for c in keep))
    merged = new.join(was, keys, "left").select(*(F.coalesce(f"_was_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns))
    return kept.unionByName(merged)


def replace_mappings(old: DataFrame, new: DataFrame, keys: list[str], today: Column) -> DataFrame:
    """Old active mappings with the keys end today and stay as history; new ones are active (SET09)."""
    ends = old.join(new.select(*keys).distinct(), keys, "left_semi")
    ended = ends.withColumns({"valid_to": F.when(F.col("is_active"), F.coalesce("valid_to", today)).otherwise(F.col("valid_to")), "is_active": F.lit(False)})
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    fresh = new.withColumns({"is_active": F.lit(True), "valid_from": today, "valid_to": F.lit(None).cast(old.schema["valid_to"].dataType)})
    return kept.unionByName(ended).unionByName(fresh.select(*old.columns))


def tombstoned(old: DataFrame, alive: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """Active rows without a key in ``alive`` become inactive and get a reason (SET10)."""
    live = alive.select(*keys).distinct().withColumn("_alive", F.lit(True))
    gone = F.col("is_active") & F.col("_alive").isNull()
    joined = old.join(live, keys, "left")
    return joined.withColumns({"reason": F.when(gone, reason).otherwise(F.col("reason")), "is_active": F.col("is_active") & F.col("_alive").isNotNull()}).select(*old.columns)


def rebuilt_scope(old: DataFrame, new: DataFrame, scope: Column) -> DataFrame:
    """All rows of a scope are replaced by new ones (SET11, JON22)."""
    return old.filter(~F.coalesce(scope, F.lit(False))).unionByName(new)


def last_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """SET12."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def merged_map(a: Column, b: Column) -> Column:
    """Map of both; where a key is in both, b's value (SET14)."""
    mine = F.map_filter(F.coalesce(a, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.coalesce(F.map_keys(b), F.array().cast("array<string>")), k))
    return F.map_concat(mine, F.coalesce(b, F.create_map().cast("map<string,string>")))
