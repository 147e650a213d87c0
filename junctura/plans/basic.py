"""Queries of the single operators over the given tables, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, ids, rules, text
from ..operators import evaluation, select, sets
from ..streaming import windows
from . import standins as s
from .registry import query


@query("select o_custkey, o_orderkey, o_orderdate, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders where o_orderdate <= timestamp '1999-01-01') where k = 1")
def win_latest_row(t):
    """WIN01, WIN02, WIN07-WIN10, JON26."""
    o = t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return select.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.lit("1999-01-01").cast("timestamp_ntz"), "o_orderdate")


@query("select o_custkey, o_orderkey, o_orderdate from orders join (select o_custkey as c, max(o_orderdate) as d from orders group by 1) on c = o_custkey and d = o_orderdate")
def win_max_join(t):
    """WIN11."""
    return select.max_then_join(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate")


@query("select l_orderkey, arg_min(l_partkey, l_linenumber * 1000000 + l_partkey) as first, arg_max(l_partkey, l_linenumber * 1000000 + l_partkey) as last, count(*) as n from lineitem group by 1")
def win_endpoints(t):
    """WIN12."""
    return select.endpoints(t("lineitem").withColumn("seq", F.col("l_linenumber") * 1000000 + F.col("l_partkey")), "l_orderkey", "seq", "l_partkey")


@query(
    """with x as (select l_orderkey, cast(l_linenumber as bigint) * 1000000000 + l_partkey * 100 + l_quantity as seq, l_suppkey % 5 as v from lineitem), c as (select *, lag(v) over (partition by l_orderkey order by seq) as b from x),
d as (select l_orderkey, v, lead(v) over (partition by l_orderkey order by seq) as nxt from c where b is null or b <> v) select l_orderkey, v as "from", nxt as "to" from d where nxt is not null"""
)
def win_adjacency(t):
    """WIN13."""
    x = t("lineitem").withColumns({"seq": F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 100 + F.col("l_quantity"), "v": F.col("l_suppkey") % 5})
    return select.adjacency(x, "l_orderkey", "seq", "v")


@query("select * from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3")
def win_top3(t):
    """WIN03, WIN05, WIN15, SRT02."""
    return select.ranked(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).filter("rank <= 3").drop("o_totalprice")


@query(
    """select l_orderkey, cast(seq as bigint) as stop_sequence, l_partkey, printf('%02d:%02d:00', 6 + ((seq - 1) * 5) // 60, ((seq - 1) * 5) % 60) as arrival_time
from (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as seq from lineitem where l_partkey in (select p_partkey from part where p_size > 5))"""
)
def win_sequence_fallback(t):
    """WIN14, FN24."""
    stops = t("part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    rows = select.ranked(t("lineitem").join(stops, "l_partkey", "left_semi"), ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")], "seq")
    return rows.select("l_orderkey", F.col("seq").cast("long").alias("stop_sequence"), "l_partkey", rules.time_or_fallback(F.lit(None).cast("string"), F.col("seq")).alias("arrival_time"))


@query("select event_id, user_id, date_diff('hour', ts, timestamp '2024-02-01') > 168 as stale from events")
def win_stale_flag(t):
    """WIN16."""
    age = F.timestamp_diff("HOUR", F.date_trunc("HOUR", "ts"), F.lit("2024-02-01").cast("timestamp_ntz"))
    return t("events").select("event_id", "user_id", (age > 168).alias("stale"))


@query("select event_id, user_id, value from events where event_id > 500 order by event_id limit 100")
def srt_keyset_page(t):
    """SRT05, SRT09."""
    return select.keyset_page(t("events").select("event_id", "user_id", "value"), "event_id", 500, 100)


@query("select o_orderkey, o_orderpriority, o_totalprice from orders order by case when o_orderpriority = '1-URGENT' then 0 when o_orderpriority = '2-HIGH' then 1 else 2 end, o_totalprice desc, o_orderkey limit 300")
def srt_weighted_order(t):
    """SRT01, SRT04, SRT06, SRT07."""
    weight = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(weight, F.desc("o_totalprice"), "o_orderkey").limit(300)


@query('select * from (select o_orderkey as trip, first, last from (select o_orderkey, o_custkey as first, o_orderpriority as last, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as k from orders) where k = 1) order by trip limit 6')
def srt_first_distinct(t):
    """SRT10."""
    rows = t("orders").select(F.col("o_orderkey").alias("trip"), F.col("o_custkey").alias("first"), F.col("o_orderpriority").alias("last"))
    return select.first_distinct(rows, ["first", "last"], [F.col("trip")], 6)


@query(
    """with p as (select l_orderkey, list_transform(list_sort(list({'s': l_linenumber * 1000000 + l_partkey, 'v': l_suppkey % 20})), lambda x: x.v) as p from lineitem group by 1 having count(*) >= 2),
q as (select unnest([{'a': p[1], 'b': p[len(p)]}, {'a': p[1], 'b': p[len(p) // 2 + 1]}, {'a': p[len(p) // 2 + 1], 'b': p[len(p)]}]) as x from p) select distinct x.a as "from", x.b as "to" from q where x.a <> x.b"""
)
def srt_sampled_pairs(t):
    """SRT12."""
    x = t("lineitem").select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq"), (F.col("l_suppkey") % 20).alias("v"))
    return select.sampled_pairs(x, "l_orderkey", "seq", "v")


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'O' and o_orderdate <= timestamp '2000-01-01' and o_orderpriority in ('1-URGENT', '2-HIGH')")
def fil_scope(t):
    """FIL01-FIL03, FIL12: the predicates reach the scan."""
    return t("orders").filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= F.lit("2000-01-01").cast("timestamp_ntz")) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"with {s.STATIONS} select id, lat, lon from stations where lat between 47.2 - 20 / 110.574 and 47.4 + 20 / 110.574 and lon between 8.1 - 20 / (111.32 * cos(radians(47.3))) and 8.6 + 20 / (111.32 * cos(radians(47.3)))")
def fil_bbox(t):
    """FIL04-FIL06."""
    return s.stations(t).filter(geo.in_box(F.col("lat"), F.col("lon"), *geo.padded_box(47.2, 8.1, 47.4, 8.6, 20))).select("id", "lat", "lon")


@query(f"with {s.STATIONS} select id, len(sources) as n from stations where list_contains(sources, 3) and list_has_any(sources, [7, 9])")
def fil_arrays(t):
    """FIL10."""
    return s.stations(t).filter(F.array_contains("sources", 3) & F.arrays_overlap("sources", F.array(F.lit(7).cast("long"), F.lit(9).cast("long")))).select("id", F.size("sources").cast("long").alias("n"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, event_type is not distinct from 'click' as clicked from events where json_exists(props, '$.k')")
def fil_json(t):
    """FIL09, FIL11."""
    k = F.get_json_object("props", "$.k")
    return t("events").filter(k.isNotNull()).select("event_id", k.cast("long").alias("k"), F.col("event_type").eqNullSafe(F.lit("click")).alias("clicked"))


@query("select c_custkey, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'other') as segment, printf('%.6f', round(c_acctbal / 7, 6) + 0.0) as rounded from customer")
def fil_coalesce_round(t):
    """FIL16, FIL17."""
    return t("customer").select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit("other")).alias("segment"), F.format_string("%.6f", F.round(F.col("c_acctbal") / 7, 6)).alias("rounded"))


@query("select c_custkey, n_name, r_name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where c_acctbal > 0")
def jon_lookup(t):
    """JON01, JON05."""
    return t("customer").filter("c_acctbal > 0").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("select c_custkey, c_name from customer c where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def jon_semi(t):
    """JON07."""
    return t("customer").select("c_custkey", "c_name").join(t("orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("select p_partkey, p_name from part p where not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R' and l_quantity > 45)")
def jon_anti(t):
    """JON08."""
    return t("part").select("p_partkey", "p_name").join(t("lineitem").filter("l_returnflag = 'R' and l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")


@query(f"with {s.MAPPINGS}, l as (select l_orderkey, l_linenumber, l_suppkey % 10 as source_id, l_partkey as ref, case when l_quantity > 30 then 'own' || l_partkey end as own from lineitem) select l_orderkey, l_linenumber, ref, coalesce(own, cast(station_id as varchar)) as stop_id from l left join (select * from mappings where is_active) using (source_id, ref) where coalesce(own, cast(station_id as varchar)) is not null")
def jon_resolve_stop(t):
    """JON06, JON20."""
    from ..operators.export import resolved_stop_times

    rows = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 10).alias("source_id"), F.col("l_partkey").alias("stop_ref"), F.when(F.col("l_quantity") > 30, F.concat(F.lit("own"), "l_partkey")).alias("station_id"))
    maps = s.mappings(t).withColumn("station_id", F.col("station_id").cast("string"))
    return resolved_stop_times(rows, maps).select("l_orderkey", "l_linenumber", F.col("stop_ref").alias("ref"), "stop_id")


@query("select o_custkey, count(*) as n, count(*) filter (o_orderstatus = 'F') as finished, round(avg(o_totalprice) filter (o_orderstatus = 'O'), 6) as open_mean, count(distinct case when o_orderpriority like '1%' then o_orderdate end) as urgent_days, cast(sum(round(o_totalprice * 100)) as bigint) as cents from orders group by 1")
def agg_filtered(t):
    """AGG01-AGG03, AGG24."""
    status = F.col("o_orderstatus")
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(status == "F").alias("finished"), F.round(F.avg(F.when(status == "O", F.col("o_totalprice"))), 6).alias("open_mean"), F.count_distinct(F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderdate"))).alias("urgent_days"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("select l_partkey, array_to_string(list_sort(list(distinct l_suppkey)), ',') as suppliers, array_to_string(list(l_suppkey order by l_orderkey, l_linenumber, l_suppkey), ',') as ordered from lineitem group by 1")
def agg_arrays(t):
    """AGG04, AGG05, FN41."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"])
    return t("lineitem").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_suppkey")), ",").alias("suppliers"), F.array_join(ordered, ",").alias("ordered"))


@query("""select user_id, '{' || string_agg('"' || event_type || '":' || n, ',' order by event_type) || '}' as counts from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1""")
def agg_key_value(t):
    """AGG06, AGG07."""
    n = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    return n.groupBy("user_id").agg(F.to_json(F.map_from_entries(entries)).alias("counts"))


@query(f"with {s.STATIONS} select country, round(avg(lat), 6) as clat, round(avg(lon), 6) as clon, min(lat) as south, max(lat) as north, min(lon) as west, max(lon) as east, count(lat) as located from stations group by 1 having count(*) > 1")
def agg_centroid_extent(t):
    """AGG08, AGG09, AGG11, AGG26."""
    return s.stations(t).groupBy("country").agg(F.round(F.avg("lat"), 6).alias("clat"), F.round(F.avg("lon"), 6).alias("clon"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.count("lat").alias("located"), F.count("*").alias("n")).filter("n > 1").drop("n")


@query("select o_custkey, case when bool_or(o_orderpriority = '1-URGENT') then 'urgent' when bool_or(o_orderpriority = '2-HIGH') then 'high' else 'other' end as worst, array_to_string(list_filter([case when bool_or(o_orderstatus = 'P') then 'pending' end, case when sum(o_totalprice) > 1000000 then 'large' end], lambda x: x is not null), ',') as flags from orders group by 1")
def agg_priority_flags(t):
    """AGG12, AGG13."""
    p, has = F.col("o_orderpriority"), lambda c: F.max(c.cast("int")) == 1
    flags = F.array_compact(F.array(F.when(has(F.col("o_orderstatus") == "P"), "pending"), F.when(F.sum("o_totalprice") > 1000000, "large")))
    return t("orders").groupBy("o_custkey").agg(F.when(has(p == "1-URGENT"), "urgent").when(has(p == "2-HIGH"), "high").otherwise("other").alias("worst"), F.array_join(flags, ",").alias("flags"))


@query("select cast((select count(*) from orders) as bigint) as orders, cast((select count(*) from orders where o_orderstatus = 'O') as bigint) as open, (select strftime(max(o_orderdate), '%Y-%m-%d') from orders) as newest, cast((select count(*) from lineitem where l_returnflag = 'R') as bigint) as returned")
def agg_summary(t):
    """AGG14, AGG15: one aggregate per table."""
    o = t("orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("newest"))
    return o.crossJoin(F.broadcast(t("lineitem").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"))))  # one row each


@query(f"with {s.STATIONS}, tok as (select distinct id, country, unnest(string_split({s.loose('name')}, ' ')) as token from stations) select country, token, count(*) as df from tok where token not in ('bahnhof', 'hauptbahnhof', 'station', 'halt', 'haltestelle', 'busbahnhof', 'bus', 'tram') group by 1, 2")
def agg_token_df(t):
    """AGG16, FN04, FN38."""
    from ..operators.merge_queue import prepared, token_frequency

    return token_frequency(prepared(s.stations(t)))


@query(
    """with x as (select event_type, list_sort(list(value)) as v from events where value is not null group by 1)
select event_type, v[greatest(1, cast(ceil(len(v) * 0.95) as int))] as nearest, v[greatest(0, cast(floor(len(v) * 0.95) as int) - 1) + 1] as floored, v[cast(round_even((len(v) - 1) * 0.5, 0) as int) + 1] as rounded, median(value) as middle from x join events using (event_type) group by 1, 2, 3, 4"""
)
def agg_ranks(t):
    """AGG20-AGG23."""
    v = F.collect_list("value")
    return t("events").groupBy("event_type").agg(evaluation.nearest_rank(v, 0.95).alias("nearest"), evaluation.floor_rank(v, 0.95).alias("floored"), evaluation.rounded_rank(v, 0.5).alias("rounded"), F.median("value").alias("middle"))


@query("select doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) as normal from documents")
def fn_normalize(t):
    """FN01."""
    return t("documents").select("doc_id", text.normalize_name(F.col("text")).alias("normal"))


_BARE = "lower(strip_accents(text))"
_LIGATURES = f"replace(replace(replace(replace({_BARE}, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o')"


@query(
    f"""select doc_id, trim(regexp_replace({_BARE}, '[\\^`¨¯´·¸]', '', 'g')) as folded, trim(regexp_replace({_LIGATURES}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as plain,
trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_BARE}, '\\babzw\\b', ' abzweig ', 'g'), '\\bbh?f\\b', ' bahnhof ', 'g'), '\\bhbf\\b', ' hauptbahnhof ', 'g'), '\\bstr\\b', ' strasse ', 'g'), '[^a-z0-9]+', ' ', 'g')) as loose from documents"""
)
def fn_loose_name(t):
    """FN02, FN03, FN05, FN33."""
    c = F.col("text")
    return t("documents").select("doc_id", text.fold(c).alias("folded"), text.loose_name(c, expand=False).alias("plain"), text.loose_name(c).alias("loose"))


@query(f"with n as (select distinct p_name as name from part), g as (select name, {s.grams('name')} as g from n) select a.name as a, b.name as b, round({s.similarity('a.g', 'b.g')}, 6) as similarity from g a join g b on a.name < b.name and substr(a.name, 1, 1) = substr(b.name, 1, 1)")
def fn_trigram(t):
    """FN06."""
    n = t("part").select(F.col("p_name").alias("name")).distinct()
    g = n.select("name", text.trigrams(F.col("name")).alias("g"), F.substring("name", 1, 1).alias("k"))
    a, b = g.select(F.col("name").alias("a"), F.col("g").alias("ga"), "k"), g.select(F.col("name").alias("b"), F.col("g").alias("gb"), "k")
    return a.join(b, "k").filter("a < b").select("a", "b", F.round(text.set_similarity(F.col("ga"), F.col("gb")), 6).alias("similarity"))


@query(
    f"""with {s.STATIONS} select a.id, round({s.haversine("a.lat", "a.lon", "b.lat", "b.lon")}, 4) as metres, round(sqrt(pow(6378137 * radians(b.lon - a.lon), 2) + pow(6378137 * (ln(tan(pi() / 4 + radians(b.lat) / 2)) - ln(tan(pi() / 4 + radians(a.lat) / 2))), 2)), 3) as planar,
cast(floor(6378137 * radians(a.lon) / 2000) as bigint) as tile_x, case when a.lat is not null then printf('g%03d_%03d', cast(floor(a.lat + 90) as int), cast(floor(a.lon + 180) as int)) else 'zzz' || lower(coalesce(a.country, '')) end as grid from stations a join stations b on b.id = a.id + 1"""
)
def fn_distances(t):
    """FN10-FN12, SRC06."""
    st = s.stations(t)
    a = st.select("id", "lat", "lon", "country")
    b = st.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    c = [F.col(x) for x in ("lat", "lon", "lat2", "lon2")]
    return a.join(b, "id").select("id", F.round(geo.haversine_m(*c), 4).alias("metres"), F.round(geo.planar_3857_m(*c), 3).alias("planar"), geo.tile(geo.x_3857(F.col("lon"))).alias("tile_x"), geo.grid_id(F.col("lat"), F.col("lon"), F.col("country")).alias("grid"))


@query(
    """select event_id, case when value is null then 'missing' when value * 60 <= 250 then 'supporting' when value * 60 <= 1000 then 'informational' else 'warning' end as status, case when value * 60 <= 50 then 'same_location' when value * 60 <= 250 then 'nearby' when value * 60 <= 5000 then 'far_apart' else 'too_far' end as label,
case when value * 60 <= 50 then 1.0 when value * 60 <= 250 then 0.85 when value * 60 <= 1000 then 0.6 when value * 60 <= 5000 then 0.25 else 0.05 end::double as score, cast(greatest(30, least(900, round_even(value * 60 / 1.25, 0))) as int) as seconds from events"""
)
def fn_bands(t):
    """FN13, FN14."""
    m = F.col("value") * 60
    return t("events").select("event_id", geo.distance_status(m).alias("status"), geo.distance_label(m).alias("label"), geo.distance_score(m).alias("score"), geo.walk_seconds(m).alias("seconds"))


@query("select p_partkey, 'gstn_' || substr(md5('hard|' || p_partkey), 1, 24) as hard, 'gstn_' || substr(md5('geo|' || p_name || '|' || p_size), 1, 24) as geo, 'x_' || substr(sha256(p_name), 1, 24) as long_id from part")
def fn_stable_ids(t):
    """FN15, FN39."""
    return t("part").select("p_partkey", ids.station_id("hard", F.col("p_partkey")).alias("hard"), ids.station_id("geo", F.col("p_name"), F.col("p_size")).alias("geo"), ids.hashed("x_", F.col("p_name"), 256).alias("long_id"))


_TEXT = "lower(concat_ws(' ', p_type, p_name, case p_size % 4 when 0 then 'ICE' when 1 then 'tram' when 2 then 'RB' else '' end))"


@query(
    f"""select p_partkey, case when regexp_matches({_TEXT}, 'high_speed|high-speed|ice|tgv|railjet|freccia') then 'high-speed' when regexp_matches({_TEXT}, 'tram|metro|subway|bus|u-bahn|s-bahn|local') then 'local' else 'regional' end as tier,
case p_size % 4 when 1 then '0' else '2' end as route_type, case when p_size % 5 = 0 then 'local' when p_size % 4 = 0 then 'high-speed' else 'regional' end as feed_tier from part"""
)
def fn_tiers(t):
    """FN21-FN23."""
    mode = F.when(F.col("p_size") % 4 == 0, "ICE").when(F.col("p_size") % 4 == 1, "tram").when(F.col("p_size") % 4 == 2, "RB").otherwise("")
    desc = F.when(F.col("p_size") % 5 == 0, "x tier:local y")
    return t("part").select("p_partkey", rules.trip_tier(F.col("p_type"), F.col("p_name"), mode).alias("tier"), rules.route_type(F.lower(mode)).alias("route_type"), rules.route_tier(desc, F.lit("2"), mode, F.col("p_name")).alias("feed_tier"))


@query(
    """select l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate + to_hours(cast(l_quantity as int)) + to_minutes(l_linenumber), '%Y-%m-%dT%H:%M:%SZ') as instant, (l_partkey % 28 + 1) <= case l_linenumber when 2 then 28 else 31 end and l_linenumber <> 0 as valid from lineitem"""
)
def fn_time_iso(t):
    """FN25, FN29."""
    clock = F.format_string("%02d:%02d:00", F.col("l_quantity").cast("int"), F.col("l_linenumber"))
    date = F.format_string("2023-%02d-%02d", F.col("l_linenumber"), (F.col("l_partkey") % 28 + 1).cast("int"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rules.service_instant(F.col("l_shipdate"), clock).alias("instant"), rules.is_iso_date(date).alias("valid"))


_SIM, _OV, _D = "(l_quantity / 50.0)", "(l_linenumber - 1)", "case when l_partkey % 9 <> 0 then l_partkey % 1700 end"


@query(
    f"""with x as (select l_orderkey, l_linenumber, l_partkey, {_SIM} as sim, {_OV} as ov, {_D} as d, l_suppkey % 3 = 0 as eq, case when l_suppkey % 2 = 0 then 1.0 else 0.7 end as cat from lineitem)
select l_orderkey, l_linenumber, l_partkey, cast(round(least(greatest(sim, 0), 1) * 0.55::double + least(ov / 4, 1) * 0.15::double + case when d is null and eq then 0.20 when d is null then 0.08 when d <= 50 then 0.20 when d <= 250 then 0.18 when d <= 500 then 0.14 when d <= 1000 then 0.09 when d <= 1500 then 0.04 else 0 end::double + cat::double * 0.10::double, 4) as double) as confidence,
case when (eq and d <= 250) or (sim >= 0.97 and coalesce(d, 0) <= 100) then 'strong' when (sim >= 0.87 and d <= 500) or (d is null and (eq or sim >= 0.92) and ov >= 1) then 'probable' when (ov >= 1 and d <= 1000) or (d is null and sim >= 0.80 and ov >= 1) then 'weak' end as status from x"""
)
def fn_match_score(t):
    """FN16-FN18."""
    sim, ov, d, eq = F.expr("l_quantity / 50.0"), F.col("l_linenumber") - 1, F.expr(f"cast({_D} as double)"), F.col("l_suppkey") % 3 == 0
    cat = rules.category_compatibility(F.when(F.col("l_suppkey") % 2 == 0, "").otherwise("shop"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rules.match_confidence(sim, ov, d, eq, cat).alias("confidence"), rules.match_status(sim, ov, d, eq).alias("status"))


@query("select distinct a, b from (select o_custkey as a, o_orderkey % 100 as b from orders union all select o_orderkey % 100, o_custkey from orders)")
def set_symmetrize(t):
    """SET01-SET03."""
    return sets.symmetrized(t("orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 100).alias("b")), "a", "b").distinct()


@query("select c_custkey, 'balance' as metric, round(c_acctbal, 2) as value from customer union all select c_custkey, 'nation', cast(c_nationkey as double) from customer")
def set_unpivot(t):
    """SET05."""
    return sets.unpivot(t("customer"), ["c_custkey"], [{"metric": F.lit("balance"), "value": F.round("c_acctbal", 2)}, {"metric": F.lit("nation"), "value": F.col("c_nationkey").cast("double")}])


@query("select c_custkey as id, case when c_custkey % 3 = 0 then c_acctbal + 1 else c_acctbal end as balance, c_mktsegment as segment from customer union all select c_custkey + 10000000, c_acctbal + 1, 'new' from customer where c_custkey % 6 = 0")
def set_upsert(t):
    """SET07, SET08."""
    old = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    new = old.filter("id % 3 = 0").unionByName(old.filter("id % 6 = 0").withColumn("id", F.col("id") + 10000000)).select("id", (F.col("balance") + 1).alias("balance"), F.lit("new").alias("segment"))
    return sets.upsert(old, new, ["id"], keep=["segment"])


@query(
    f"""with {s.MAPPINGS}, old as (select *, date '2024-01-01' as valid_from, cast(null as date) as valid_to from mappings), new as (select source_id, ref, station_id + 1 as station_id from mappings where ref % 4 = 0)
select source_id, ref, station_id, is_active and ref % 4 <> 0 as is_active, cast(valid_from as varchar) as valid_from, cast(case when ref % 4 = 0 and is_active then date '2024-06-01' else valid_to end as varchar) as valid_to from old union all select source_id, ref, station_id, true, '2024-06-01', null from new"""
)
def set_scd2(t):
    """SET09."""
    day = lambda d: F.lit(d).cast("date")
    old = s.mappings(t).withColumns({"valid_from": day("2024-01-01"), "valid_to": F.lit(None).cast("date")})
    new = s.mappings(t).filter("ref % 4 = 0").select("source_id", "ref", (F.col("station_id") + 1).alias("station_id"))
    out = sets.replace_mappings(old, new, ["source_id", "ref"], day("2024-06-01"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("valid_from", "valid_to")})


@query("select c_custkey, c_acctbal > 0 and exists (select 1 from orders where o_custkey = c_custkey) as is_active, case when c_acctbal > 0 and not exists (select 1 from orders where o_custkey = c_custkey) then 'orphaned' end as reason from customer")
def set_tombstone(t):
    """SET10."""
    old = t("customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("is_active"), F.lit(None).cast("string").alias("reason"))
    return sets.tombstoned(old, t("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], "orphaned")


@query("select o_custkey, o_orderkey, o_totalprice from orders where o_custkey % 5 <> 0 union all select o_custkey, o_orderkey, -1.0 from orders where o_custkey % 5 = 0 and o_orderstatus = 'O'")
def set_rebuilt_scope(t):
    """SET11, JON22."""
    o = t("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    new = t("orders").filter("o_custkey % 5 = 0 and o_orderstatus = 'O'").select("o_custkey", "o_orderkey", F.lit(-1.0).alias("o_totalprice"))
    return sets.rebuilt_scope(o, new, F.col("o_custkey") % 5 == 0)


@query("select o_custkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus from orders group by 1")
def set_last_wins(t):
    """SET12."""
    return sets.last_wins(t("orders").select("o_custkey", "o_orderstatus", "o_orderkey"), ["o_custkey"], F.col("o_orderkey")).drop("o_orderkey")


@query("select time_bucket(interval '1 hour', ts) as start, time_bucket(interval '1 hour', ts) + interval '1 hour' as \"end\", event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3")
def stream_tumbling(t):
    """An extension: the stream's windows, over the table."""
    out = windows.tumbling_counts(t("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("select start, event_type, count(*) as n from (select unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) as start, event_type from events) group by 1, 2")
def stream_sliding(t):
    out = windows.sliding_counts(t("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("with x as (select user_id, ts, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)), y as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, fresh desc rows unbounded preceding) as k from x) select user_id, min(ts) as start, max(ts) + interval '30 minutes' as \"end\", count(*) as n from y group by user_id, k")
def stream_sessions(t):
    out = windows.sessions(t("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
