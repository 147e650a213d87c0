"""Queries over NeTEx archives, which tasks write from the given tables and the data source reads back."""

from __future__ import annotations

import zipfile

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .. import storage
from ..operators import network
from ..operators.graph import PART_ROWS
from ..sources import netex
from .registry import query



def _block() -> F.Column:
    return F.regexp_extract("file", r"(\d+)\.zip$", 1).cast("long")


def _written(rows: DataFrame) -> str:
    """A folder with an archive for each ``block``; its entries hold the rows' xml in order of k. A block has some thousand rows."""
    where = storage.new_dir(rows.sparkSession, "netex")

    def write(group: pd.DataFrame) -> pd.DataFrame:
        fs, folder = storage.filesystem(where)
        fs.create_dir(folder, recursive=True)
        block = int(group["block"].iloc[0])
        with fs.open_output_stream(f"{folder}/{block}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for entry, part in group.sort_values(["entry", "k"]).groupby("entry"):
                z.writestr(entry, f'<Publication xmlns="http://www.netex.org.uk/netex"><frames>{"".join(part["xml"])}</frames></Publication>')
        return pd.DataFrame({"block": [block]})

    rows.select("block", "entry", "k", "xml").groupBy("block").applyInPandas(write, "block long").count()
    return where


def _xml(template: str, **values) -> F.Column:
    """A template whose {names} are columns; null makes the whole null."""
    parts = []
    for k, piece in enumerate(template.replace("}", "{").split("{")):
        parts.append(values[piece].cast("string") if k % 2 else F.lit(piece))
    return F.concat(*parts)


def _numbered(t) -> DataFrame:
    """Lines of orders with ``n``, their number in the order, as line numbers repeat."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_linestatus")
    return t("lineitem").withColumn("n", F.row_number().over(w))


def _parts(t):
    """Shuffles that run meanwhile are dealt by the number of lines, so a task's memory does not grow with it."""
    lines = t("lineitem")
    return storage.parts(lines.sparkSession, lines.count() // PART_ROWS)


def _or_none(c: F.Column) -> F.Column:
    return F.coalesce(c, F.lit(""))


@query("select 'S' || p_partkey as scheduled, case when p_partkey % 3 > 0 then 'Q' || p_partkey end as quay, case when p_partkey % 3 = 1 or p_partkey % 3 = 2 then 'P' || (p_partkey // 10) when p_size > 5 then 'X' || p_size end as place from part where p_partkey % 3 > 0 or p_size > 5")
def netex_references(t):
    """SRC01, SRC03: parts as quays and scheduled points of archives that tasks write, read back."""
    k = F.col("p_partkey")
    told = F.when(k % 3 > 0, _xml('<QuayRef ref="Q{k}"/>', k=k)).when(F.col("p_size") > 5, _xml('<StopPlaceRef ref="X{s}"/>', s=F.col("p_size")))
    assigned = _or_none(_xml('<PassengerStopAssignment id="A{k}"><ScheduledStopPointRef ref="S{k}"/>{told}</PassengerStopAssignment>', k=k, told=told))
    quay = _xml('<StopPlace id="P{p}"><quays><Quay id="Q{k}"/></quays></StopPlace>', p=F.floor(k / 10), k=k)
    where = _written(t("part").select(F.floor(k / 5000).alias("block"), F.lit("site.xml").alias("entry"), k.alias("k"), F.concat(assigned, quay).alias("xml")))
    return netex.reference_maps(netex.elements(t("part").sparkSession, where, netex.PLACES))


STOPS_SQL = """
with p as (select p_partkey as k, p_partkey // 5000 as block, p_partkey // 10 as g, p_brand, p_size, p_size > 25 as located, p_size % 2 = 0 as own from part),
places as (select block, g, arg_min(p_brand, k) as name, arg_min(case when located then p_size end, k) as lat, min(k) as k from p group by all),
first as (select block, places.g, places.name, case when p.located then p.p_size end as lat from places join p using (k, block))
select block, 'P' || g as ref, 'P' || g as place_ref, name, cast(lat as double) as lat, lat / 2 as lon, null as hard_id, case when lat is null then 'zzzde' else 'g' || lpad(cast(lat + 90 as varchar), 3, '0') || '_' || lpad(cast(180 + floor(lat / 2) as varchar), 3, '0') end as grid_id from (select block, g, name, cast(lat as bigint) as lat from first)
union all
select block, ref, 'P' || g, name, cast(lat as double), lat / 2, hard_id, case when lat is null then 'zzzde' else 'g' || lpad(cast(lat + 90 as varchar), 3, '0') || '_' || lpad(cast(180 + floor(lat / 2) as varchar), 3, '0') end from (
  select p.block, 'Q' || k as ref, p.g, name, cast(case when own then p_size + 1 else lat end as bigint) as lat, case when k % 5 = 0 then 'T' || p_size when k % 5 = 1 then 'U' || k end as hard_id from p join first on first.g = p.g and first.block = p.block
  union all select p.block, 'S' || k, p.g, name, cast(lat as bigint), null from p join first on first.g = p.g and first.block = p.block where k % 3 < 2)
"""


@query(STOPS_SQL)
def netex_stops(t):
    """SRC01, SRC02, SRC04-SRC06: parts as quays in places and as scheduled points that are assigned to a place, to a quay or to nothing."""
    k, size = F.col("p_partkey"), F.col("p_size")
    spot = lambda lat: _xml("<Location><Longitude>{lon}</Longitude><Latitude>{lat}</Latitude></Location>", lat=lat, lon=lat / 2)
    quay = F.concat(_xml('<Quay id="Q{k}">', k=k), _or_none(F.when(size % 2 == 0, spot(size + 1))), _or_none(F.when(k % 5 == 0, _xml("<Track>T{s}</Track>", s=size)).when(k % 5 == 1, _xml("<keyList><KeyValue><Key>UIC</Key><Value>U{k}</Value></KeyValue></keyList>", k=k))), F.lit("</Quay>"))
    place = F.concat(_xml('<StopPlace id="P{g}"><quays>{quay}</quays><Name>{name}</Name>', g=F.floor(k / 10), quay=quay, name=F.col("p_brand")), _or_none(F.when(size > 25, F.concat(F.lit("<Centroid>"), spot(size), F.lit("</Centroid>")))), F.lit("</StopPlace>"))
    told = F.when(k % 3 == 0, _xml('<StopPlaceRef ref="P{g}"/>', g=F.floor(k / 10))).when(k % 3 == 1, _xml('<QuayRef ref="Q{k}"/>', k=k))
    point = F.concat(_xml('<ScheduledStopPoint id="S{k}"/>', k=k), _or_none(_xml('<PassengerStopAssignment id="A{k}"><ScheduledStopPointRef ref="S{k}"/>{told}</PassengerStopAssignment>', k=k, told=told)))
    entry = F.concat(F.lit("site_"), F.floor(k / 10) % 2, F.lit(".xml"))
    rows = t("part").select(F.floor(k / 5000).alias("block"), entry.alias("entry"), k.alias("k"), F.concat(point, place).alias("xml"))
    found = netex.elements(rows.sparkSession, _written(rows), netex.PLACES)
    columns = (_block().alias("block"), "ref", "place_ref", "name", "lat", "lon", "hard_id", "grid_id")
    return netex.stop_places(found, "DE").withColumn("place_ref", F.col("ref")).select(*columns).unionByName(netex.stop_points(found, "DE").select(*columns))


def _journeys(t) -> DataFrame:
    """Orders as journeys: even ones with a pattern and passing times in reverse order of line numbers, odd ones with calls."""
    o, n = F.col("l_orderkey"), F.col("n")
    arrival, departure = F.when(F.col("l_tax") > 0.02, F.format_string("%02d:%02d:00", F.col("l_quantity").cast("int"), n)), F.when(F.col("l_linestatus") == "O", F.format_string("%02d:%02d:30", F.col("l_quantity").cast("int"), n))
    point = _xml('<StopPointInJourneyPattern id="X{o}-{n}" order="{r}"><ScheduledStopPointRef ref="S{s}"/></StopPointInJourneyPattern>', o=o, n=n, r=F.lit(1000) - n, s=F.col("l_suppkey"))
    times = F.concat(_or_none(_xml("<ArrivalTime>{a}</ArrivalTime>", a=arrival)), _or_none(_xml("<DepartureTime>{d}</DepartureTime>", d=departure)))
    passing = _xml('<TimetabledPassingTime><StopPointInJourneyPatternRef ref="X{o}-{n}"/>{t}</TimetabledPassingTime>', o=o, n=n, t=times)
    nested = F.concat(_or_none(_xml("<Arrival><Time>{a}</Time></Arrival>", a=arrival)), _or_none(_xml("<Departure><Time>{d}</Time></Departure>", d=departure)))
    call = _xml('<Call order="{n}"><ScheduledStopPointRef ref="S{s}"/>{t}</Call>', n=n, s=F.col("l_suppkey"), t=nested)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), c.alias("x")))), lambda v: v["x"]), "")
    lines = _numbered(t).groupBy(o.alias("o_orderkey")).agg(joined(point).alias("points"), joined(passing).alias("passing"), joined(call).alias("calls"))
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    line = F.when(status == "F", F.lit('<Line id="LF"><Name>Long F</Name><ShortName>F</ShortName><TransportMode>rail</TransportMode></Line>')).when(status == "O", F.lit('<Line id="LO"><PublicCode>Omega</PublicCode></Line>')).otherwise(F.lit(""))
    even = k % 2 == 0
    pattern = F.when(even, _xml('<ServiceJourneyPattern id="P{k}"><RouteView><LineRef ref="L{s}"/></RouteView><pointsInSequence>{p}</pointsInSequence></ServiceJourneyPattern>', k=k, s=status, p=F.col("points"))).otherwise(F.lit(""))
    days = F.when(F.col("o_orderpriority").startswith("1"), _xml('<dayTypes><DayTypeRef ref="D{s}"/><DayTypeRef ref="other"/></dayTypes>', s=status)).when(F.col("o_orderpriority").startswith("2"), _xml('<validityConditions><AvailabilityConditionRef ref="A{s}"/></validityConditions>', s=status)).otherwise(F.lit(""))
    led = F.when(even, _xml('<ServiceJourneyPatternRef ref="P{k}"/>', k=k)).otherwise(_xml('<LineRef ref="L{s}"/>', s=status))
    body = F.when(even, F.concat(F.lit("<passingTimes>"), "passing", F.lit("</passingTimes>"))).otherwise(F.concat(F.lit("<calls>"), "calls", F.lit("</calls>")))
    rows = t("orders").join(lines, "o_orderkey").select(F.floor(k / 5000).alias("block"), F.concat(F.lit("line_"), k % 3, F.lit(".xml")).alias("entry"), k.alias("k"), _xml('{line}{pattern}<ServiceJourney id="J{k}">{led}{days}{body}</ServiceJourney>', k=k, line=line, pattern=pattern, led=led, days=days, body=body).alias("xml"))
    return netex.elements(rows.sparkSession, _written(rows), netex.JOURNEYS, "timetable")


@query("""select o_orderkey // 5000 as block, 'J' || o_orderkey as trip_id, case when o_orderpriority like '1%' then 'D' || o_orderstatus when o_orderpriority like '2%' then 'A' || o_orderstatus end as service_id, 'L' || o_orderstatus as route_id,
case o_orderstatus when 'F' then 'F' when 'O' then 'Omega' else 'LP' end as route_short_name, case o_orderstatus when 'F' then 'Long F' when 'O' then 'Omega' else 'LP' end as route_long_name, case o_orderstatus when 'F' then 'Long F' when 'O' then 'Omega' else 'LP' end as trip_headsign,
case o_orderstatus when 'F' then 'rail' end as transport_mode, case when o_orderkey % 2 = 0 then 'P' || o_orderkey end as pattern_ref from orders where o_orderkey in (select l_orderkey from lineitem)""")
def netex_trips(t):
    """SRC08: orders as journeys; service from day types or conditions, names from lines."""
    with _parts(t):
        return storage.stored(netex.trips(_journeys(t)).withColumn("file", _block()).withColumnRenamed("file", "block"), "netex-trips")


@query("""with k as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax, l_linestatus) as n from lineitem),
l as (select l_orderkey as o, n, l_suppkey as s, case when l_tax > 0.02 then printf('%02d:%02d:00', cast(floor(l_quantity) as int), cast(n as int)) end as a, case when l_linestatus = 'O' then printf('%02d:%02d:30', cast(floor(l_quantity) as int), cast(n as int)) end as d from k where l_orderkey in (select o_orderkey from orders))
select o // 5000 as block, 'J' || o as trip_id, 'S' || s as stop_ref, row_number() over (partition by o order by case when o % 2 = 0 then -n else n end) as stop_sequence, coalesce(a, d) as arrival_time, coalesce(d, a) as departure_time from l where coalesce(a, d) is not null""")
def netex_stop_times(t):
    """SRC07: lines of orders as passing times, whose order the pattern has, and as calls; those without any time drop out before they are numbered."""
    with _parts(t):
        return storage.stored(netex.stop_times(_journeys(t)).withColumn("file", _block()).withColumnRenamed("file", "block"), "netex-stop-times")


PATTERNS_SQL = """
with k as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax, l_linestatus) as n from lineitem),
p as (select l_orderkey as o, l_orderkey // 5000 as block, l_orderkey % 3 as e, l_orderkey % 2 as odd, min(l_returnflag) as line, list('S' || l_suppkey order by n) as refs from k group by all),
c as (select * from p qualify row_number() over (partition by block, odd, line, refs order by e, o) = 1),
steps as (select block, o, case line when 'N' then 'fast' when 'A' then 'code' else 'T' || o end as label, case when odd = 1 then 'bus' when line = 'N' then 'rail' else '' end as mode, unnest(refs) as ref, generate_subscripts(refs, 1) as pos from c),
placed as (select steps.*, coalesce('Q' || s_nationkey, 'synthetic:' || ref) as place from steps left join supplier on ref = 'S' || s_suppkey and s_acctbal > 0),
pairs as (select *, lag(place) over (partition by block, o order by pos) as before from placed)
select block, 'route' as kind, place as a, label as b, mode as c, count(distinct o) as hits from placed group by all
union all select block, 'next', before, place, null, count(distinct o) from pairs where before <> place group by all
"""


@query(PATTERNS_SQL)
def netex_patterns(t):
    """SRC09, SRC10: orders as patterns over suppliers; equal ones of an archive count once, the first; routes and neighbours of places."""
    o, n = F.col("l_orderkey"), F.col("n")
    even = o % 2 == 0
    ref = _xml('<ScheduledStopPointRef ref="S{s}"/>', s=F.col("l_suppkey"))
    told = _or_none(F.when(F.col("s_acctbal") > 0, _xml('<PassengerStopAssignment id="A{o}-{n}">{ref}<QuayRef ref="Q{q}"/></PassengerStopAssignment>', o=o, n=n, ref=ref, q=F.col("s_nationkey"))))
    stop = F.when(even, _xml('<StopPointInJourneyPattern id="X{o}-{n}" order="{n}">{ref}</StopPointInJourneyPattern>', o=o, n=n, ref=ref)).otherwise(_xml('<Call order="{n}">{ref}</Call>', n=n, ref=ref))
    # later stops stand first, and one of no order is no stop
    listed = lambda c, desc: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(n.alias("n"), c.alias("x"))), asc=not desc), lambda v: v["x"]), "")
    led = _numbered(t).join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", "s_acctbal"), "l_suppkey", "left")
    rows = led.groupBy(o.alias("k")).agg(listed(told, False).alias("told"), listed(stop, True).alias("stops"), F.min("l_returnflag").alias("line"))
    k, line = F.col("k"), F.col("line")
    lines = F.when(line == "N", F.lit('<Line id="LN"><Name>name</Name><ShortName>fast</ShortName><TransportMode>rail</TransportMode></Line>')).when(line == "A", F.lit('<Line id="LA"><Name>name</Name><PublicCode>code</PublicCode></Line>')).otherwise(F.lit(""))
    pattern = F.when(k % 2 == 0, _xml('<ServiceJourneyPattern id="T{k}"><RouteView><LineRef ref="L{l}"/></RouteView><pointsInSequence>{s}<StopPointInJourneyPattern order="0"><ScheduledStopPointRef ref="none"/></StopPointInJourneyPattern></pointsInSequence></ServiceJourneyPattern>', k=k, l=line, s=F.col("stops"))).otherwise(
        _xml('<ServiceJourney id="T{k}"><LineRef ref="L{l}"/><TransportMode>bus</TransportMode><calls>{s}</calls></ServiceJourney>', k=k, l=line, s=F.col("stops"))
    )
    xml = rows.select(F.floor(k / 5000).alias("block"), F.concat(F.lit("x_line_"), k % 3, F.lit(".xml")).alias("entry"), "k", F.concat("told", pattern, lines).alias("xml"))
    with _parts(t):
        # routes and neighbours are of the same steps
        found = netex.elements(rows.sparkSession, _written(xml), netex.PATTERNS, "network")
        steps = storage.stored(netex.pattern_steps(found, network.deduplicated_patterns(netex.patterns(found))), "netex-steps")
        routes = network.pattern_routes(steps).select(_block().alias("block"), F.lit("route").alias("kind"), F.col("place").alias("a"), F.col("label").alias("b"), F.col("mode").alias("c"), "hits")
        pairs = network.pattern_adjacency(steps).select(_block().alias("block"), F.lit("next").alias("kind"), F.col("from_place").alias("a"), F.col("to_place").alias("b"), F.lit(None).cast("string").alias("c"), "hits")
        return storage.stored(routes.unionByName(pairs), "netex-patterns")
