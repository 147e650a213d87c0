"""Railway tables derived from the given tables, in Spark and in the checking SQL.

Parts are stations (name and brand, a brand number as country, coordinates from the key), suppliers are providers, orders are trips and their
lines stop times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LAT, LON = "case when {k} % 17 <> 0 then 47 + ({k} * 37 % 1000) / 1000.0 end", "case when {k} % 17 <> 0 then 8 + ({k} * 53 % 1000) / 1000.0 end"


def _e(text: str, k: str):
    return F.expr(f"cast({text.format(k=k)} as double)")


def stations(t) -> DataFrame:
    """id, name, country, lat, lon, sources (sorted, of ten)."""
    sources = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 10)).alias("sources"))
    p = t("part").join(sources, "p_partkey", "left")
    return p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.when(F.col("p_partkey") % 13 != 0, F.substring("p_brand", 7, 9)).alias("country"), _e(LAT, "p_partkey").alias("lat"), _e(LON, "p_partkey").alias("lon"), F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"))


STATIONS = f"""src as (select l_partkey as id, list_sort(list(distinct l_suppkey % 10)) as sources from lineitem group by 1),
stations as (select p_partkey as id, p_name || ' ' || p_brand as name, case when p_partkey % 13 <> 0 then substr(p_brand, 7) end as country, cast({LAT.format(k="p_partkey")} as double) as lat, cast({LON.format(k="p_partkey")} as double) as lon, coalesce(sources, []) as sources from part left join src on id = p_partkey)"""


def places(t) -> DataFrame:
    """id, source_id, ref, name, country, parent_ref, topo_ref, hard_id, lat, lon: parts; each tenth is the parent of those up to the next."""
    k = F.col("p_partkey")
    lost = (k % 17 == 0) | (k % 3 == 1)
    return t("part").select(
        k.alias("id"), F.lit("s").alias("source_id"), k.alias("ref"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.substring("p_brand", 7, 9).alias("country"), F.when(k % 10 != 0, k - k % 10).alias("parent_ref"), F.when(k % 4 != 0, F.floor(k / 20)).alias("topo_ref"),
        F.when(k % 7 == 0, F.concat(F.lit("h"), F.floor(k / 14).cast("string"))).otherwise("").alias("hard_id"),
        F.when(~lost, 47 + F.floor(k / 20) % 100 / 10.0 + (k * 37 % 100) / 10000.0).alias("lat"), F.when(~lost, 8 + (k * 53 % 100) / 10000.0).alias("lon"),
    )


PLACES = """places as (select p_partkey as id, p_partkey as ref, p_name || ' ' || p_brand as name, substr(p_brand, 7) as country, case when p_partkey % 10 <> 0 then p_partkey - p_partkey % 10 end as parent_ref, case when p_partkey % 4 <> 0 then p_partkey // 20 end as topo_ref,
  case when p_partkey % 7 = 0 then 'h' || (p_partkey // 14) else '' end as hard_id,
  case when p_partkey % 17 <> 0 and p_partkey % 3 <> 1 then 47 + ((p_partkey // 20) % 100) / 10.0 + (p_partkey * 37 % 100) / 10000.0 end as lat,
  case when p_partkey % 17 <> 0 and p_partkey % 3 <> 1 then 8 + (p_partkey * 53 % 100) / 10000.0 end as lon from part)"""


def points(t) -> DataFrame:
    """source_id, place_ref, point_id, lat, lon: up to two for a part whose key isn't a multiple of five."""
    k, n = F.col("place_ref"), F.col("n")
    base = t("part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("place_ref"), F.explode(F.sequence(F.lit(0), F.col("p_partkey") % 2)).alias("n"))
    return base.select(F.lit("s").alias("source_id"), "place_ref", (k * 2 + n).alias("point_id"), (47 + F.floor(k / 20) % 100 / 10.0 + ((k * 41 + n * 7) % 100) / 10000.0).alias("lat"), (8 + ((k * 59 + n * 11) % 100) / 10000.0).alias("lon"))


POINTS = """points as (select p_partkey as place_ref, p_partkey * 2 + n as point_id, 47 + ((p_partkey // 20) % 100) / 10.0 + ((p_partkey * 41 + n * 7) % 100) / 10000.0 as lat, 8 + ((p_partkey * 59 + n * 11) % 100) / 10000.0 as lon
  from part, unnest(range(0, 1 + p_partkey % 2)) as u(n) where p_partkey % 5 <> 0)"""


def mappings(t) -> DataFrame:
    """source_id, ref, station_id, is_active: distinct suppliers of parts."""
    return t("lineitem").select((F.col("l_suppkey") % 10).alias("source_id"), F.col("l_partkey").alias("ref")).distinct().select("source_id", "ref", F.floor(F.col("ref") / 4).cast("long").alias("station_id"), ((F.col("ref") + F.col("source_id")) % 5 != 0).alias("is_active"))


MAPPINGS = "mappings as (select source_id, ref, ref // 4 as station_id, (ref + source_id) % 5 <> 0 as is_active from (select distinct l_suppkey % 10 as source_id, l_partkey as ref from lineitem))"


def haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    return f"case when {a} + {b} + {c} + {d} is not null then 2 * 6371008.8 * asin(sqrt(least(1.0, {h}))) end"


def grams(x: str) -> str:
    words = f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def similarity(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0.0)"


def loose(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
