"""The global station model: coordinate evidence, resolution, grouping, mappings (PIP02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo, ids, text
from .graph import eps_clusters

NEAR_M, FAR_M = 250.0, 1000.0
SIBLING_SPREAD_M, TOPO_SPREAD_M = 1000.0, 1500.0
SOURCES = ("parent", "points", "siblings", "topo")


def scoped(df: DataFrame, country: str | None = None, source_id: str | None = None, as_of: str | None = None) -> DataFrame:
    """Rows of a scope; a blank or missing value is no limit (FIL01)."""
    if country:
        df = df.filter(F.col("country") == country)
    if source_id:
        df = df.filter(F.col("source_id") == source_id)
    return df.filter(F.col("snapshot_date") <= F.lit(as_of).cast("date")) if as_of else df


def scope_key(country: str | None, source_id: str | None, as_of: str | None) -> str:
    """FIL02."""
    return "|".join((country or "ALL", as_of or "latest", source_id or "ALL"))


def with_spread(members: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """Per group: centroid, number and largest distance from the centroid of members with coordinates (AGG08, AGG10, JON16)."""
    there = members.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    centre = there.groupBy(*by).agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"), F.count("*").alias("n"))
    spread = there.join(centre, by).groupBy(*by).agg(F.max(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))).alias("spread"))
    return centre.join(spread, by).select(*by, F.col("clat").alias(f"{prefix}_lat"), F.col("clon").alias(f"{prefix}_lon"), F.col("n").alias(f"{prefix}_n"), F.coalesce("spread", F.lit(0.0)).alias(f"{prefix}_spread"))


def peers(places: DataFrame, key: str, prefix: str) -> DataFrame:
    """Per place: centroid, number and spread of the other places with its ``key`` (JON03, JON04).

    The others' centroid follows from the group's sums, so no pairs are made; the spread is that of the whole group's
    members around the centroid of the others, taken over group members by one join.
    """
    there = places.filter(F.col(key).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    sums = there.groupBy("source_id", key).agg(F.sum("lat").alias("slat"), F.sum("lon").alias("slon"), F.count("*").alias("sn"))
    has = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    mine = lambda c: F.when(has, F.col(c)).otherwise(0.0)
    n = F.col("sn") - F.when(has, 1).otherwise(0)
    others = places.join(sums, ["source_id", key]).withColumn(f"{prefix}_n", n).filter(F.col(f"{prefix}_n") > 0)
    centred = others.select("source_id", "ref", key, f"{prefix}_n", ((F.col("slat") - mine("lat")) / n).alias(f"{prefix}_lat"), ((F.col("slon") - mine("lon")) / n).alias(f"{prefix}_lon"))
    member = there.select("source_id", key, F.col("ref").alias("other"), F.col("lat").alias("olat"), F.col("lon").alias("olon"))
    spread = centred.join(member, ["source_id", key]).filter("other <> ref").groupBy("source_id", "ref").agg(F.max(geo.haversine_m(F.col("olat"), F.col("olon"), F.col(f"{prefix}_lat"), F.col(f"{prefix}_lon"))).alias(f"{prefix}_spread"))
    return centred.drop(key).join(spread, ["source_id", "ref"])


def coordinate_evidence(places: DataFrame, points: DataFrame) -> DataFrame:
    """places: source_id, ref, parent_ref, topo_ref, lat, lon, ...; points: source_id, place_ref, lat, lon. Adds each source's evidence (JON02, JON05)."""
    parent = places.select("source_id", F.col("ref").alias("parent_ref"), F.col("lat").alias("parent_lat"), F.col("lon").alias("parent_lon"))
    own = with_spread(points, ["source_id", "place_ref"], "points").withColumnRenamed("place_ref", "ref")
    return (
        places.join(parent, ["source_id", "parent_ref"], "left")
        .join(own, ["source_id", "ref"], "left")
        .join(peers(places, "parent_ref", "siblings"), ["source_id", "ref"], "left")
        .join(peers(places, "topo_ref", "topo"), ["source_id", "ref"], "left")
    )


def resolved(evidence: DataFrame) -> DataFrame:
    """The coordinate source of each place and how far it can be trusted (FN19).

    Adds coord_source, rlat, rlon, supports, conflicts, max_signal_m, confidence. Own coordinates win; then the parent's and the points' (the points
    if near the parent, or at least two and not all in one spot); then siblings and topographic peers if at least two and close together.
    """
    has = lambda p: F.col(f"{p}lat").isNotNull() & F.col(f"{p}lon").isNotNull()
    between = geo.haversine_m(F.col("parent_lat"), F.col("parent_lon"), F.col("points_lat"), F.col("points_lon"))
    points_win = (between <= NEAR_M) | ((F.col("points_n") >= 2) & (between > 75))
    source = (
        F.when(has(""), "self")
        .when(has("parent_") & has("points_"), F.when(points_win, "points").otherwise("parent"))
        .when(has("parent_"), "parent")
        .when(has("points_"), "points")
        .when((F.col("siblings_n") >= 2) & (F.col("siblings_spread") <= SIBLING_SPREAD_M), "siblings")
        .when((F.col("topo_n") >= 2) & (F.col("topo_spread") <= TOPO_SPREAD_M), "topo")
        .otherwise("missing")
    )
    picked = evidence.withColumn("coord_source", source)
    pick = lambda axis: F.coalesce(F.when(F.col("coord_source") == "self", F.col(axis)), *(F.when(F.col("coord_source") == s, F.col(f"{s}_{axis}")) for s in SOURCES))
    placed = picked.withColumn("rlat", pick("lat")).withColumn("rlon", pick("lon"))
    away = {s: F.when(F.col("coord_source") != s, geo.haversine_m(F.col("rlat"), F.col("rlon"), F.col(f"{s}_lat"), F.col(f"{s}_lon"))) for s in SOURCES}
    count = lambda test: sum((F.when(test(d), 1).otherwise(0) for d in away.values()), F.lit(0))
    signals = placed.withColumns({"supports": count(lambda d: d <= NEAR_M), "conflicts": count(lambda d: d > FAR_M), "max_signal_m": F.greatest(*(F.coalesce(d, F.lit(0.0)) for d in away.values()))})
    s = F.col("coord_source")
    confidence = (
        F.when(s == "missing", "unresolved")
        .when(s == "self", "high")
        .when(s.isin("parent", "points"), F.when(F.col("supports") >= 1, "high").when(F.col("conflicts") == 0, "medium").otherwise("low"))
        .when(s == "siblings", "medium")
        .otherwise("low")
    )
    return signals.withColumn("confidence", confidence)


#: Warning codes of the sources that stand in for a place's own coordinates, as fixed values.
USED = {"parent": "used_parent_geom", "points": "used_child_stop_points", "siblings": "used_sibling_centroid", "topo": "used_topographic_place_centroid"}


def warnings(df: DataFrame) -> Column:
    """Codes that apply to rows of resolved(), in a fixed order (FN19, AGG13)."""
    source = F.col("coord_source")
    others = sum((F.when((source != p) & F.col(f"{p}_lat").isNotNull() & F.col(f"{p}_lon").isNotNull(), 1).otherwise(0) for p in SOURCES), F.lit(0))
    alone = F.col("rlat").isNotNull() & (F.col("supports") == 0)
    codes = [
        (F.col("lat").isNull() | F.col("lon").isNull(), "missing_self_geom"),
        *((source == p, code) for p, code in USED.items()),
        (F.col("max_signal_m") > FAR_M, "signal_conflict_gt_1000m"),
        (alone, "no_supporting_signal"),
        (alone & (others <= 1), "single_weak_signal"),
        (source == "missing", "unresolved_missing_all_sources"),
    ]
    return F.array_compact(F.array(*(F.when(test, code) for test, code in codes)))


def grouped(places: DataFrame, eps: float = 500.0) -> DataFrame:
    """places: id (long), hard_key, normalized_name, rlat, rlon. Adds station_id and method (FN15, WIN06).

    A hard key makes a group; without one, places of one name that steps of ``eps`` projected units link; the rest by name. Cluster numbers are ranks of the
    clusters' smallest ids within a name.
    """
    soft = places.filter("hard_key is null and rlat is not null and rlon is not null")
    clusters = eps_clusters(soft.select("id", F.col("normalized_name").alias("name"), geo.x_3857(F.col("rlon")).alias("x"), geo.y_3857(F.col("rlat")).alias("y")), eps)
    named = clusters.join(soft.select("id", "normalized_name"), "id")
    from pyspark.sql import Window

    numbers = named.select("normalized_name", "cluster").distinct().withColumn("number", F.row_number().over(Window.partitionBy("normalized_name").orderBy("cluster")) - 1)
    numbered = named.join(numbers, ["normalized_name", "cluster"]).select("id", "number")
    joined = places.join(numbered, "id", "left")
    name = F.col("normalized_name")
    return joined.withColumns(
        {
            "station_id": F.when(F.col("hard_key").isNotNull(), ids.station_id("hard", F.col("hard_key"))).when(F.col("number").isNotNull(), ids.station_id("geo", name, F.col("number"))).otherwise(ids.station_id("name", name)),
            "method": F.when(F.col("hard_key").isNotNull(), "hard_id").when(F.col("number").isNotNull(), "name_geo").otherwise("name_only"),
        }
    ).drop("number")


def stations(members: DataFrame) -> DataFrame:
    """One row per station: least name and country, mean coordinates, first present source, worst confidence (AGG12)."""
    has = lambda c, v: F.max(F.when(F.col(c) == v, 1).otherwise(0)) == 1

    def first(c: str, order: tuple[str, ...]) -> Column:
        out = F.lit(None).cast("string")
        for v in reversed(order):
            out = F.when(has(c, v), v).otherwise(out)
        return out

    return members.groupBy("station_id").agg(
        F.min("name").alias("name"), F.min("country").alias("country"), F.avg("rlat").alias("lat"), F.avg("rlon").alias("lon"), F.count("*").cast("long").alias("members"),
        first("coord_source", ("self", "parent", "points", "siblings", "topo", "missing")).alias("coord_source"), first("confidence", ("unresolved", "low", "medium", "high")).alias("confidence"), F.sum("conflicts").cast("long").alias("conflicts"),
    )


def transfer_edges(points: DataFrame) -> DataFrame:
    """points: station_id, point_id, lat, lon. All ordered pairs of a station's points with walking seconds (JON14, GRF05)."""
    a = points.select("station_id", F.col("point_id").alias("from_id"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    b = points.select("station_id", F.col("point_id").alias("to_id"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    d = geo.haversine_m(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    return a.join(b, "station_id").filter("from_id <> to_id").select("station_id", "from_id", "to_id", geo.walk_seconds(d).alias("seconds"))


def alerts(df: DataFrame, n: int) -> DataFrame:
    """Places whose coordinates need a look, worst first (FIL13)."""
    worst = F.when(F.col("confidence") == "unresolved", 0).when(F.col("confidence") == "low", 1).otherwise(2)
    return df.filter(F.col("confidence").isin("low", "unresolved") | (F.col("conflicts") > 0)).orderBy(worst, F.col("conflicts").desc(), "name", "id").limit(n)


def build(places: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (places with station_id) and stations. places: id, source_id, ref, name, country, parent_ref, topo_ref, hard_id, lat, lon."""
    placed = resolved(coordinate_evidence(places, points))
    members = grouped(placed.withColumn("hard_key", F.nullif(F.trim("hard_id"), F.lit(""))).withColumn("normalized_name", text.normalize_name(F.col("name"))))
    return members, stations(members)
