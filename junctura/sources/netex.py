"""NeTEx archives as tables (SRC01-SRC09): rows of elements come from netex_entries, all else is joins and windows.

Archives are apart: ids of one never meet those of another. What an element refers to is looked up as of its place in the archive, so a
later entry does not change what an earlier one meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import storage
from ..functions import geo
from . import netex_entries

#: Keys of key lists that hold an id, and that name the place around, in order; fixed values.
ID_KEYS = ("uic", "ifopt", "eva", "stopplaceref", "globalid")
PLACE_KEYS = ("stopplaceref", "parentstopplace", "parentsiteref")
PLACES = (*netex_entries.PLACES, "PassengerStopAssignment")
JOURNEYS = ("Line", "PassengerStopAssignment", "ServiceJourneyPattern", "ServiceJourney")
PATTERNS = ("Line", "PassengerStopAssignment", *netex_entries.PATTERNS)
_POINT = "array<struct<id:string,order:string,ref:map<string,string>,arrival:string,departure:string>>"
_DOC = f"id string, text map<string,string>, ref map<string,string>, descriptor string, kv map<string,string>, at array<array<string>>, view string, points {_POINT}, calls {_POINT}, passing {_POINT}, days array<string>, conditions array<string>"
ENTRY = ("file", "entry_index")


def elements(spark: SparkSession, folder: str, kinds: tuple[str, ...], use: str = "stops") -> DataFrame:
    """file, entry, entry_index, event, kind, ancestor, doc for each element of the kinds in the archives of a folder.

    Archives are read once, here: what is made of the elements asks for them several times.
    """
    return storage.stored(netex_entries.read(spark, netex_entries.archives(folder), use, kinds), "netex-elements")


def _parsed(found: DataFrame, *kinds: str) -> DataFrame:
    return found.filter(F.col("kind").isin(*kinds)).withColumn("d", F.from_json("doc", _DOC)).drop("doc")


def _at(m: Column | str, k: str) -> Column:
    return F.nullif(F.try_element_at(F.col(m) if isinstance(m, str) else m, F.lit(k)), F.lit(""))


def _as_of(asked: DataFrame, facts: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """asked with ``value``: that of the last fact of the same key at or before its place in order. One shuffle, no pairs."""
    kept = [c for c in asked.columns if c not in (*by, *order)]
    told = facts.filter(F.col(value).isNotNull()).select(*by, *order, F.lit(0).alias("_asked"), value, F.lit(None).cast(asked.select(F.struct(*kept)).schema[0].dataType).alias("_row"))
    both = told.unionByName(asked.select(*by, *order, F.lit(1).alias("_asked"), F.lit(None).cast(facts.schema[value].dataType).alias(value), F.struct(*kept).alias("_row")))
    w = Window.partitionBy(*by).orderBy(*order, "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("_asked = 1").select(*by, *order, value, "_row.*")


def _first(rows: DataFrame, by: list[str]) -> DataFrame:
    """The first row of each key in an archive."""
    kept = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*kept), F.struct("entry_index", "event")).alias("r")).select(*by, "r.*")


def _quays(found: DataFrame) -> DataFrame:
    """file, quay, quay_place, since: the place that a quay is first said to be of, and the entry that says so (SRC03)."""
    q = _parsed(found, "Quay").filter("d.id is not null")
    own = F.coalesce(_at("d.ref", "ParentSiteRef"), F.nullif("ancestor", F.lit("")), *(_at("d.kv", k) for k in PLACE_KEYS), _at("d.ref", "StopPlaceRef"))
    rows = q.select("file", "entry_index", "event", F.col("d.id").alias("quay"), own.alias("place"), _at("d.ref", "QuayRef").alias("other"))
    named = _first(rows.filter("place is not null").drop("other"), ["file", "quay"])
    # a quay that only names another quay is of the place of that one, where it stands before
    led = rows.filter("place is null and other is not null").drop("place").join(named.select("file", F.col("quay").alias("other"), "place", F.struct("entry_index", "event").alias("_at")), ["file", "other"]).filter(F.col("_at") < F.struct("entry_index", "event"))
    both = named.unionByName(led.select(*named.columns))
    return _first(both, ["file", "quay"]).select("file", "quay", F.col("place").alias("quay_place"), F.col("entry_index").alias("since"), F.struct("entry_index", "event").alias("since_at"))


def _assignments(found: DataFrame) -> DataFrame:
    """file, entry_index, event, scheduled, quay, place of each assignment; the place is the one named, else that of the quay as known by then."""
    told = _parsed(found, "PassengerStopAssignment").select("file", "entry_index", "event", _at("d.ref", "ScheduledStopPointRef").alias("scheduled"), _at("d.ref", "QuayRef").alias("quay"), _at("d.ref", "StopPlaceRef").alias("named")).filter("scheduled is not null")
    known = told.join(_quays(found).drop("since"), ["file", "quay"], "left")
    by_quay = F.when(F.col("since_at") < F.struct("entry_index", "event"), F.col("quay_place"))
    return known.select("file", "entry_index", "event", "scheduled", "quay", F.coalesce("named", by_quay).alias("place"))


def reference_maps(found: DataFrame) -> DataFrame:
    """scheduled, quay, place: what assignments tell of each scheduled point in the end, the last one that tells it (SRC03).

    A place named outright counts, else that of the assignment's quay: of the place around it, or that it refers to.
    """
    at = F.struct("file", "entry_index", "event").alias("at")
    quays = _quays(found).select("file", "quay", "quay_place")
    told = _assignments(found).join(quays, ["file", "quay"], "left").select(at, "scheduled", "quay", F.coalesce("place", "quay_place").alias("place"))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("at", c)))[c].alias(c)
    return told.groupBy("scheduled").agg(last("quay"), last("place"))


def _located(d: DataFrame) -> DataFrame:
    """lat and lon of the first location below the element that is valid (SRC02)."""
    pair = lambda p: F.struct(p[0].try_cast("double").alias("lat"), p[1].try_cast("double").alias("lon"))
    valid = F.filter(F.transform(F.coalesce("d.at", F.array()), pair), lambda p: F.coalesce(geo.valid(p["lat"], p["lon"]), F.lit(False)))
    return d.withColumn("_p", F.try_element_at(valid, F.lit(1))).withColumns({"lat": F.col("_p.lat"), "lon": F.col("_p.lon")}).drop("_p")


def _hard_id(public: tuple[str, ...], private: tuple[str, ...]) -> Column:
    return F.coalesce(*(_at("d.text", k) for k in (*public, *private)), *(_at("d.kv", k) for k in ID_KEYS))


def stop_places(found: DataFrame, country: str) -> DataFrame:
    """file, ref, name, lat, lon, parent_ref, topo_ref, hard_id, country, grid_id: the first place of each id that has a name (SRC02, SRC05, SRC06)."""
    d = _located(_parsed(found, "StopPlace").filter("d.id is not null"))
    name = F.coalesce(_at("d.text", "Name"), F.nullif("d.descriptor", F.lit("")))
    rows = d.select("file", "entry_index", "event", F.col("d.id").alias("ref"), name.alias("name"), "lat", "lon", _at("d.ref", "ParentSiteRef").alias("parent_ref"), _at("d.ref", "TopographicPlaceRef").alias("topo_ref"), _hard_id(("PublicCode",), ("PrivateCode",)).alias("hard_id"))
    return _first(rows.filter("name is not null"), ["file", "ref"]).withColumns({"country": F.lit(country), "grid_id": geo.grid_id(F.col("lat"), F.col("lon"), F.lit(country))})


def stop_points(found: DataFrame, country: str) -> DataFrame:
    """file, ref, kind, place_ref, name, lat, lon, topo_ref, hard_id, country, grid_id: quays and scheduled points, the first of each id that gets a name (SRC02, SRC04).

    The place: that of the assignment; of the assignment's quay; the quay's own as first said; ParentSiteRef; the place around it; key values; StopPlaceRef; the
    place of QuayRef; else the point itself. Name and coordinates that are missing are the place's. All as known up to the point's entry.
    """
    d = _located(_parsed(found, "Quay", "ScheduledStopPoint").filter("d.id is not null"))
    own = F.coalesce(_at("d.ref", "ParentSiteRef"), F.nullif("ancestor", F.lit("")), *(_at("d.kv", k) for k in PLACE_KEYS), _at("d.ref", "StopPlaceRef"))
    rows = d.select(
        "file", "entry_index", F.col("d.id").alias("ref"), "event", "kind", own.alias("own"), _at("d.ref", "QuayRef").alias("quay_ref"), F.coalesce(_at("d.text", "Name"), F.nullif("d.descriptor", F.lit(""))).alias("name"), "lat", "lon",
        _at("d.ref", "TopographicPlaceRef").alias("topo_ref"), _hard_id(("PublicCode", "PlatformCode"), ("PrivateCode", "Track")).alias("hard_id"),
    )
    # an entry's references are collected before its points are read: its assignments count for all of its points
    told = _assignments(found).groupBy("file", "entry_index", F.col("scheduled").alias("ref")).agg(*(F.max(F.when(F.col(c).isNotNull(), F.struct("event", c)))[c].alias(a) for c, a in (("place", "told_place"), ("quay", "told_quay"))))
    for c in ("told_place", "told_quay"):
        rows = _as_of(rows, told.select("file", "entry_index", "ref", c), ["file", "ref"], ["entry_index"], c)
    quays = _quays(found).select("file", "quay", "quay_place", "since")
    for c, to in (("told_quay", "by_told"), ("ref", "by_own"), ("quay_ref", "by_ref")):
        q = quays.select("file", F.col("quay").alias(c), F.col("quay_place").alias(to), F.col("since").alias("_since"))
        rows = rows.join(q, ["file", c], "left").withColumn(to, F.when(F.col("_since") <= F.col("entry_index"), F.col(to))).drop("_since")
    rows = rows.withColumn("place_ref", F.coalesce("told_place", "by_told", "by_own", "own", "by_ref", "ref"))
    p = _located(_parsed(found, "StopPlace").filter("d.id is not null")).select("file", "entry_index", "event", F.col("d.id").alias("place_ref"), F.coalesce(_at("d.text", "Name"), F.nullif("d.descriptor", F.lit(""))).alias("place_name"), F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"))
    first = _first(p, ["file", "place_ref"]).select("file", "place_ref", F.col("entry_index").alias("_since"), "place_name", "place_lat", "place_lon")
    known = F.col("_since") <= F.col("entry_index")
    rows = rows.join(first, ["file", "place_ref"], "left").withColumn("name", F.coalesce("name", F.when(known, F.col("place_name"))))
    bare = F.col("lat").isNull()
    rows = rows.withColumns({c: F.when(bare, F.when(known, F.col(f"place_{c}"))).otherwise(F.col(c)) for c in ("lat", "lon")})
    out = _first(rows.filter("name is not null").select("file", "ref", "entry_index", "event", "kind", "place_ref", "name", "lat", "lon", "topo_ref", "hard_id"), ["file", "ref"])
    return out.withColumns({"country": F.lit(country), "grid_id": geo.grid_id(F.col("lat"), F.col("lon"), F.lit(country))})


def at_places(times: DataFrame, maps: DataFrame) -> DataFrame:
    """stop_times() with ``place_ref``: the place of the scheduled point that a time refers to, else what it refers to itself."""
    known = maps.filter("place is not null").select(F.col("scheduled").alias("stop_ref"), "place")
    return times.join(known, "stop_ref", "left").withColumn("place_ref", F.coalesce("place", "stop_ref")).drop("place")


def with_synthetic_points(places: DataFrame, points: DataFrame) -> DataFrame:
    """Points, and ``ref::sp`` for places that have none (PIP01). points: ref, place_ref, lat, lon."""
    bare = places.join(points.select(F.col("place_ref").alias("ref")), "ref", "left_anti")
    return points.unionByName(bare.select(F.concat("ref", F.lit("::sp")).alias("ref"), F.col("ref").alias("place_ref"), "lat", "lon"))


def _lines(found: DataFrame) -> DataFrame:
    text = lambda k: _at("d.text", k)
    return _parsed(found, "Line").filter("d.id is not null").select(*ENTRY, "event", F.col("d.id").alias("line_ref"), F.struct(text("Name").alias("name"), text("ShortName").alias("short_name"), text("PublicCode").alias("public_code"), text("TransportMode").alias("mode")).alias("line"))


def _journeys(found: DataFrame) -> DataFrame:
    """The first journey of each id, with its pattern and its line as its entry has them so far."""
    j = _parsed(found, "ServiceJourney").filter("d.id is not null").select(
        "file", "entry_index", "event", F.col("d.id").alias("trip_id"), _at("d.ref", "ServiceJourneyPatternRef").alias("pattern_ref"), _at("d.ref", "LineRef").alias("own_line"), _at("d.text", "TransportMode").alias("own_mode"),
        F.coalesce(F.try_element_at("d.days", F.lit(1)), F.try_element_at("d.conditions", F.lit(1))).alias("service_id"), F.col("d.calls").alias("calls"), F.col("d.passing").alias("passing"),
    )
    j = _first(j, ["file", "trip_id"])
    p = _parsed(found, "ServiceJourneyPattern").filter("d.id is not null").select(*ENTRY, "event", F.col("d.id").alias("pattern_ref"), F.struct(F.nullif("d.view", F.lit("")).alias("line_ref"), F.transform("d.points", lambda x: F.struct(x["id"].alias("id"), x["order"].alias("order"), _at(x["ref"], "ScheduledStopPointRef").alias("ref"))).alias("points")).alias("pattern"))
    j = _as_of(j, p, [*ENTRY, "pattern_ref"], ["event"], "pattern").withColumn("line_ref", F.coalesce("pattern.line_ref", "own_line"))
    return _as_of(j, _lines(found), [*ENTRY, "line_ref"], ["event"], "line")


def trips(found: DataFrame) -> DataFrame:
    """file, trip_id, service_id, route_id, route_short_name, route_long_name, trip_headsign, transport_mode, pattern_ref of journeys (SRC08)."""
    short = F.coalesce("line.short_name", "line.public_code", "line_ref")
    long = F.coalesce("line.name", short)
    return _journeys(found).select("file", "trip_id", "service_id", F.col("line_ref").alias("route_id"), short.alias("route_short_name"), long.alias("route_long_name"), F.coalesce(long, short, "trip_id").alias("trip_headsign"), F.coalesce("own_mode", "line.mode").alias("transport_mode"), "pattern_ref")


def stop_times(found: DataFrame) -> DataFrame:
    """file, trip_id, stop_ref, stop_sequence, arrival_time, departure_time of journeys (SRC07).

    Passing times count where the journey's pattern is known and one of them has a stop and a time; else the calls do. Order, else place in the
    document, numbers them from 1. A missing arrival is the departure, and the other way round.
    """
    num = lambda c, k: F.when(c.try_cast("int") > 0, c.try_cast("int")).otherwise(k + 1)
    time = lambda x, a, b: F.coalesce(F.nullif(x[a], F.lit("")), F.nullif(x[b], F.lit(""))).alias(f"{a}_time")
    as_times = lambda x: (time(x, "arrival", "departure"), time(x, "departure", "arrival"))
    whole = lambda rows: F.filter(rows, lambda x: x["stop_ref"].isNotNull() & x["arrival_time"].isNotNull())
    # a later point of an id replaces the one before
    points = F.map_from_entries(F.transform(F.array_distinct(F.transform("pattern.points", lambda p: p["id"])), lambda i: F.struct(i, F.element_at(F.filter("pattern.points", lambda p: p["id"] == i), -1))))
    passing = F.transform("passing", lambda x, k: F.struct(F.try_element_at(points, _at(x["ref"], "StopPointInJourneyPatternRef")).alias("p"), x.alias("x"), k.alias("k")))
    passed = F.transform(passing, lambda t: F.struct(num(t["p"]["order"], t["k"]).alias("order"), t["k"].alias("k"), t["p"]["ref"].alias("stop_ref"), *as_times(t["x"])))
    called = F.transform("calls", lambda x, k: F.struct(num(x["order"], k).alias("order"), k.alias("k"), F.coalesce(*(_at(x["ref"], r) for r in ("ScheduledStopPointRef", "StopPointRef", "StopPlaceRef"))).alias("stop_ref"), *as_times(x)))
    rows = _journeys(found).select("file", "trip_id", whole(passed).alias("passed"), whole(called).alias("called"))
    times = F.array_sort(F.when(F.coalesce(F.size("passed"), F.lit(-1)) > 0, F.col("passed")).otherwise(F.col("called")))
    return rows.select("file", "trip_id", F.posexplode(times).alias("pos", "t")).select("file", "trip_id", "t.stop_ref", (F.col("pos") + 1).cast("long").alias("stop_sequence"), "t.arrival_time", "t.departure_time")


def patterns(found: DataFrame) -> DataFrame:
    """file, entry_index, event, pattern_id, tag, line_ref, refs, label, mode (SRC09).

    Points of patterns, calls of journeys, with a positive order and a stop, sorted by order, ties as they stand; without points a pattern drops out.
    label: the line's short name, public code or name, else the pattern's id. Lines count for their whole entry, the last of an id.
    """
    ref = lambda r: F.coalesce(*(_at(r, k) for k in ("ScheduledStopPointRef", "StopPointRef", "StopPlaceRef")))
    d = _parsed(found, *netex_entries.PATTERNS).filter("d.id is not null")
    stops = F.when(F.col("kind").isin("ServiceJourneyPattern", "JourneyPattern"), F.col("d.points")).otherwise(F.col("d.calls"))
    placed = F.filter(F.transform(stops, lambda p, k: F.struct(p["order"].try_cast("int").alias("order"), k.alias("k"), ref(p["ref"]).alias("ref"))), lambda p: (p["order"] > 0) & p["ref"].isNotNull())
    rows = d.select(*ENTRY, "event", F.col("d.id").alias("pattern_id"), F.col("kind").alias("tag"), F.coalesce(F.nullif("d.view", F.lit("")), _at("d.ref", "LineRef"), _at("d.ref", "RouteRef"), F.lit("")).alias("line_ref"), F.transform(F.array_sort(placed), lambda p: p["ref"]).alias("refs"), _at("d.text", "TransportMode").alias("own_mode"))
    lines = _lines(found).groupBy(*ENTRY, "line_ref").agg(F.max_by("line", "event").alias("line"))
    led = rows.filter(F.size("refs") > 0).join(lines, [*ENTRY, "line_ref"], "left")
    return led.select(*ENTRY, "event", "pattern_id", "tag", "line_ref", "refs", F.coalesce("line.short_name", "line.public_code", "line.name", "pattern_id").alias("label"), F.coalesce("own_mode", "line.mode", F.lit("")).alias("mode"))


def pattern_steps(found: DataFrame, kept: DataFrame) -> DataFrame:
    """file, entry_index, event, label, mode, pos, place: the place of each stop of the patterns in ``kept``; a stop without assignment is ``synthetic:`` and its ref."""
    told = _parsed(found, "PassengerStopAssignment").select(*ENTRY, "event", _at("d.ref", "ScheduledStopPointRef").alias("ref"), F.coalesce(*(_at("d.ref", k) for k in ("QuayRef", "StopPointRef", "StopPlaceRef"))).alias("place")).filter("ref is not null")
    maps = told.groupBy(*ENTRY, "ref").agg(F.max_by("place", "event").alias("place"))
    stops = kept.select(*ENTRY, "event", "label", "mode", F.posexplode("refs").alias("pos", "ref"))
    return stops.join(maps, [*ENTRY, "ref"], "left").select(*ENTRY, "event", "label", "mode", "pos", F.coalesce("place", F.concat(F.lit("synthetic:"), "ref")).alias("place"))
