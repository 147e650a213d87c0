"""Queries of station lookup, curation edits and archives over derived tables, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..operators import curation, export, lookup, stations as st
from ..sources import tables as sources
from . import standins as s
from .domain import _AWAY, _RESOLVED
from .registry import query

_OTHERS = " + ".join(f"case when source <> '{p}' and {p}_lat is not null then 1 else 0 end" for p in _AWAY)


@query(
    f"""with {_RESOLVED} select id, array_to_string(list_filter([case when lat is null then 'missing_self_geom' end, case source when 'parent' then 'used_parent_geom' when 'points' then 'used_child_stop_points' when 'siblings' then 'used_sibling_centroid' when 'topo' then 'used_topographic_place_centroid' end,
case when far > 1000 then 'signal_conflict_gt_1000m' end, case when rlat is not null and supports = 0 then 'no_supporting_signal' end, case when rlat is not null and supports = 0 and {_OTHERS} <= 1 then 'single_weak_signal' end, case when source = 'missing' then 'unresolved_missing_all_sources' end], lambda w: w is not null), ',') as warnings from resolved"""
)
def coord_warnings(t):
    """FN19, AGG13."""
    r = st.resolved(st.coordinate_evidence(s.places(t), s.points(t)))
    return r.select("id", F.array_join(st.warnings(r), ",").alias("warnings"))


def _stops(t):
    """Parts as stops: pairs of parts share an id, so some names are the second of theirs."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("", "0", "1", "2", "3"))), (F.col("p_size") % 5 + 1).cast("int"))
    return t("part").select(k.alias("seq"), F.when(k % 10 == 3, k - 1).otherwise(k).cast("string").alias("stop_id"), F.concat(F.lit(" "), "p_name").alias("stop_name"), kind.alias("location_type"), F.concat(F.floor(k % 180 - 90).cast("string"), F.lit(".50")).alias("stop_lat"), F.lit("08.25").alias("stop_lon"))


_STOPS = """stops as (select p_partkey as seq, (case when p_partkey % 10 = 3 then p_partkey - 1 else p_partkey end) || '' as id, trim(p_name) as name, ['', '0', '1', '2', '3'][p_size % 5 + 1] as lt, p_partkey % 180 - 90 as lat from part),
kept as (select *, name || ' [' || id || ']' as value, 'tg_' || id as token, case lt when '1' then 110 when '2' then 10 else 30 end as rank, case when abs(lat || '.50') <= 90 then lat || '.5,8.25' end as coordinates from (select * exclude lat, lat || '' as lat from stops where name <> '' and lt not in ('2', '3', '4'))),
stations as (select * from kept qualify row_number() over (partition by value order by seq, id, lt) = 1)""".replace("abs(lat || '.50')", "abs(cast(lat || '.50' as double))")


@query(f"with {_STOPS} select value, seq, id as station_id, token, coordinates, rank from stations")
def station_index(t):
    """PIP21, FN32, FN34."""
    return lookup.index(_stops(t), "tg").select("value", "seq", "station_id", "token", "coordinates", "rank")


_BY = "{0} as (select {0} as k, id, token from (select *, lower(name) as name_fold, lower(value) as value_fold from stations) qualify row_number() over (partition by {0} order by rank desc, id, seq) = 1)"
_FORMS = """case l_linenumber % 7 when 0 then l_partkey || '' when 1 then upper(p_name) when 2 then 'Elsewhere [' || l_partkey || ' ]' when 3 then ' 47.10, ' || (l_suppkey % 300) || '.0' when 4 then 'tg_' || l_partkey when 5 then case when l_suppkey % 2 = 0 then '  ' else 'Nowhere ' || l_suppkey end else p_name || ' [' || l_partkey || '00000]' end"""


@query(
    f"""with {_STOPS}, id as (select id as k, id, token from stations qualify row_number() over (partition by id order by rank desc, id, seq) = 1), {_BY.format('value_fold')}, {_BY.format('name_fold')},
inputs as (select l_orderkey * 10 + l_linenumber as key, trim({_FORMS}) as input from lineitem join part on p_partkey = l_partkey),
parsed as (select *, nullif(trim(regexp_extract(input, '\\[([^\\[]*)\\]$', 1)), '') as bracket, regexp_matches(input, '^-?\\d+(\\.\\d+)?\\s*,\\s*-?\\d+(\\.\\d+)?$') and abs(try_cast(split_part(input, ',', 2) as double)) <= 180 as place from inputs),
found as (select p.*, coalesce(i.id, v.id, n.id) as sid, coalesce(i.token, v.token, n.token) as token from parsed p left join id i on i.k = coalesce(bracket, case when regexp_matches(input, '^\\S+$') then input end) left join value_fold v on v.k = lower(input) left join name_fold n on n.k = lower(input)),
named as (select *, case when input = '' then 'empty' when place then 'coordinates' when starts_with(input, 'tg_') then 'tagged_stop_id' when sid is not null then 'station_lookup' when bracket is not null then 'bracket_id' when regexp_matches(input, '^\\d+$') then 'numeric_stop_id' else 'raw' end as strategy from found)
select key, input, case strategy when 'coordinates' then cast(split_part(input, ',', 1)::double as varchar) || ',' || cast(split_part(input, ',', 2)::double::bigint as varchar) when 'station_lookup' then token when 'bracket_id' then 'tg_' || bracket when 'numeric_stop_id' then 'tg_' || input else input end as resolved, strategy, case when strategy = 'station_lookup' then sid end as matched from named"""
)
def station_inputs(t):
    """FN31, FN32, FN33, FN34."""
    lines = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.expr(_FORMS).alias("input"))
    return lookup.resolved(lines, lookup.index(_stops(t), "tg"), "tg")


@query(f"with {_STOPS} select value, id as station_id from stations where contains(lower(name), 'red') or contains(lower(value), 'red') or contains(id, 'Red')")
def station_search(t):
    """FIL14."""
    return lookup.search(lookup.index(_stops(t), "tg"), " Red ".strip()).select("value", "station_id")


@query("select c_custkey as id, case when code = '' or regexp_matches(code, '^[A-Z]{2}$') then code end as code from (select c_custkey, upper(trim(case c_custkey % 4 when 0 then '' when 1 then ' ' || substr(c_mktsegment, 1, 2) when 2 then lower(substr(c_mktsegment, 2, 2)) else c_mktsegment end)) as code from customer)")
def country_codes(t):
    """FN30."""
    k, m = F.col("c_custkey"), F.col("c_mktsegment")
    raw = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, F.concat(F.lit(" "), F.substring(m, 1, 2))).when(k % 4 == 2, F.lower(F.substring(m, 2, 2))).otherwise(m)
    return t("customer").select(k.alias("id"), lookup.country_code(raw).alias("code"))


def _merges(t):
    return t("lineitem").select(F.floor(F.col("l_orderkey") / 10).cast("long").alias("cluster_key"), F.col("l_orderkey").alias("entity_id"), F.col("l_partkey").alias("member"), "l_returnflag", "l_linenumber")


@query(
    """with m as (select l_orderkey // 10 as cluster_key, l_orderkey as entity_id, l_partkey as member, l_returnflag as f from lineitem), gone as (select distinct cluster_key, entity_id, member from m where f = 'R'), rest as (select * from m anti join gone using (cluster_key, entity_id, member))
select cluster_key, entity_id, count(*) as members, cast(sum(member) as bigint) as total from rest group by 1, 2 having count(distinct member) >= 2"""
)
def workspace_removals(t):
    """WSP06."""
    m = _merges(t)
    return curation.without_member(m, m.filter("l_returnflag = 'R'")).groupBy("cluster_key", "entity_id").agg(F.count("*").alias("members"), F.sum("member").alias("total"))


@query(
    """with e as (select l_orderkey as entity_id, l_linenumber as seq, case when l_returnflag = 'A' and l_linestatus = 'F' and l_linenumber = 1 then 'split' when l_returnflag = 'R' then 'rename' else 'note' end as action, l_shipdate::date || '' as value from lineitem)
select o_custkey as cluster_key, case when o_orderstatus = 'O' then 'group' else 'merge' end as kind, o_orderkey as entity_id, coalesce(n, o_orderpriority) as display_name from orders left join (select entity_id, bool_or(action = 'split') as gone, (max({'s': seq, 'v': value}) filter (action = 'rename')).v as n from e group by 1) on entity_id = o_orderkey where not coalesce(gone, false)"""
)
def workspace_composites(t):
    """WSP03."""
    kind = F.when(F.col("o_orderstatus") == "O", "group").otherwise("merge")
    c = t("orders").select(F.col("o_custkey").alias("cluster_key"), kind.alias("kind"), F.col("o_orderkey").alias("entity_id"), F.col("o_orderpriority").alias("display_name"))
    action = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), "split").when(F.col("l_returnflag") == "R", "rename").otherwise("note")
    e = t("lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").alias("seq"), action.alias("action"), F.col("l_shipdate").cast("date").cast("string").alias("value")).join(c.select("cluster_key", "kind", "entity_id"), "entity_id")
    return curation.edited_composites(c, e)


@query("select l_suppkey as cluster_key, l_orderkey as set_id, array_to_string(list_sort(list(distinct p_brand)), ',') as refs from lineitem join part on p_partkey = l_partkey group by 1, 2 having count(distinct p_brand) >= 2")
def workspace_kept_apart(t):
    """WSP07."""
    r = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("cluster_key"), F.col("l_orderkey").alias("set_id"), F.col("p_brand").alias("ref"))
    return curation.kept_apart(r).withColumn("refs", F.array_join("refs", ","))


@query("select l_suppkey, p_type, count(*) as count, row_number() over (partition by l_suppkey order by count(*) desc, p_type) as place from lineitem join part on p_partkey = l_partkey group by 1, 2")
def evidence_counts(t):
    """WSP10."""
    return curation.summary_counts(t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")), "l_suppkey", "p_type")


_KINDS = ("geographic_distance", "external_reference_conflict", "token_overlap", "shared_route_context", "country_relation", "name_exact")


@query(
    f"""with r as (select l_orderkey as k, l_linenumber as n, {list(_KINDS)}[l_partkey % 6 + 1] as kind, case when l_suppkey % 3 > 0 then case when l_partkey % 6 = 3 then floor(l_quantity) else l_quantity * 1.37 end end as raw, case when l_suppkey % 2 = 0 then l_discount end as score, case when l_returnflag = 'A' then true when l_returnflag = 'R' then false end as same from lineitem)
select k, n, case when kind = 'geographic_distance' then case when raw is null then 'Far' else cast(cast(floor(raw + 0.5) as bigint) as varchar) || 'm' end when kind = 'external_reference_conflict' and raw > 1 then cast(cast(floor(raw + 0.5) as bigint) as varchar) || 'm' when kind = 'token_overlap' and raw is not null then cast(cast(floor(raw * 100 + 0.5) as bigint) as varchar) || '%'
when kind = 'shared_route_context' and raw is not null then cast(cast(raw as bigint) as varchar) when kind = 'country_relation' then case when same then 'Same' when not same then 'Cross' else '?' end when score is not null then cast(cast(floor(score * 100 + 0.5) as bigint) as varchar) || '%' else '—' end as shown from r"""
)
def evidence_values(t):
    """WSP11."""
    c = F.col
    kind = F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (c("l_partkey") % 6 + 1).cast("int"))
    raw = F.when(c("l_suppkey") % 3 > 0, F.when(c("l_partkey") % 6 == 3, F.floor("l_quantity").cast("double")).otherwise(c("l_quantity") * 1.37))
    score, same = F.when(c("l_suppkey") % 2 == 0, c("l_discount")), F.when(c("l_returnflag") == "A", True).when(c("l_returnflag") == "R", False)
    return t("lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), curation.evidence_value(kind, raw, score, same, F.lit("far_apart")).alias("shown"))


@query(f"with {s.POINTS} select place_ref // 6 as entity_id, round(avg(case when point_id % 5 <> 0 then lat end), 7) as lat, round(avg(case when point_id % 5 <> 0 then lon end), 7) as lon from points group by 1")
def composite_places(t):
    """FN43, FN44."""
    lost = F.col("point_id") % 5 == 0
    m = s.points(t).select(F.floor(F.col("place_ref") / 6).cast("long").alias("entity_id"), F.when(~lost, F.col("lat")).alias("lat"), F.when(~lost, F.col("lon")).alias("lon"))
    return curation.composite_places(m).select("entity_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query(
    """with side as (select l_orderkey as o, list(distinct p_brand) filter (l_returnflag = 'A') as l, list(distinct p_brand) filter (l_returnflag = 'N') as r from lineitem join part on p_partkey = l_partkey group by 1), p as (select o, coalesce(l, []) as l, coalesce(r, []) as r from side), q as (select *, list_sort(list_intersect(l, r)) as sh from p where len(l) + len(r) > 0)
select o as a, array_to_string(sh, ',') as shared, array_to_string(list_sort(list_filter(l, lambda x: not list_contains(r, x))), ',') as left_only, array_to_string(list_sort(list_filter(r, lambda x: not list_contains(l, x))), ',') as right_only, round(len(sh) / (len(l) + len(r) - len(sh)), 6) as score from q"""
)
def coverage_evidence(t):
    """AGG18."""
    j = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    side = lambda f: F.collect_set(F.when(F.col("l_returnflag") == f, F.col("p_brand")))
    p = j.groupBy(F.col("l_orderkey").alias("a")).agg(F.lit(0).alias("b"), side("A").alias("left"), side("N").alias("right"))
    return curation.coverage(p).select("a", *(F.array_join(c, ",").alias(c) for c in ("shared", "left_only", "right_only")), F.round("score", 6).alias("score"))


@query(
    """with c as (select s_suppkey, coalesce(nullif(concat_ws(' - ', case when s_suppkey % 3 > 0 then s_name end, case when s_suppkey % 2 > 0 then n_name end), ''), s_suppkey || '') as label from supplier join nation on n_nationkey = s_nationkey where s_suppkey % 2 > 0 or s_acctbal > 0)
select l_orderkey as key, array_to_string(list_sort(list(distinct coalesce(label, l_suppkey || ''))), ',') as labels from lineitem left join c on s_suppkey = l_suppkey group by 1"""
)
def label_catalogue(t):
    """PIP22."""
    known = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).filter("s_suppkey % 2 > 0 or s_acctbal > 0")
    sources = known.select(F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("provider"), F.when(F.col("s_suppkey") % 2 > 0, F.col("n_name")).otherwise(" ").alias("dataset"))
    ids = t("lineitem").select(F.col("l_orderkey").alias("key"), F.concat(F.lit(" "), F.col("l_suppkey").cast("string")).alias("id"))
    return curation.labelled(ids, curation.source_labels(sources)).withColumn("labels", F.array_join("labels", ","))


@query("select l_partkey, l_suppkey, l_orderkey || '-' || l_linenumber as ref from lineitem qualify row_number() over (partition by l_partkey, l_suppkey order by (l_returnflag = 'A') desc, case when l_discount > 0.02 then l_discount end desc nulls last, l_orderkey || '-' || l_linenumber) = 1")
def best_references(t):
    """SRT11."""
    ref = F.concat_ws("-", "l_orderkey", "l_linenumber")
    r = t("lineitem").select("l_partkey", "l_suppkey", ref.alias("ref"), (F.col("l_returnflag") == "A").alias("is_primary"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("confidence"))
    return curation.best_reference(r, ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey", "ref")


@query(
    """select row_number() over (order by l_orderkey, l_linenumber, l_partkey || '', l_shipmode) - 1 as line, l_orderkey || '' as trip_id, l_linenumber || '' as stop_sequence, l_partkey || '' as stop_id, l_shipmode as note from (select *, case when l_suppkey % 3 = 0 then '' else l_returnflag || ', "' || l_linestatus || '"' end as l_shipmode from lineitem)"""
)
def export_archive(t):
    """SNK01, SNK02, SRC24: stop times written as an archive and read back."""
    note = F.when(F.col("l_suppkey") % 3 != 0, F.concat("l_returnflag", F.lit(', "'), "l_linestatus", F.lit('"')))
    rows = t("lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence"), F.col("l_partkey").alias("stop_id"), note.alias("note"))
    spark = rows.sparkSession
    where = f"{storage.new_dir(spark, 'archive')}/gtfs.zip"
    fs, at = storage.filesystem(where)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as out:
        export.write_archive({"stop_times": rows}, {"stop_times": ["trip_id", "stop_sequence"]}, out)
    return sources.gtfs_table(spark, where, "stop_times").select("line", *(F.col("fields")[c].alias(c) for c in ("trip_id", "stop_sequence", "stop_id", "note")))


@query("select 'trips' as kind, o_orderkey as id, o_orderstatus as value from orders where o_orderstatus = 'F' union all select 'routes', c_custkey, c_name from customer union all select 'stops', p_partkey, p_brand from part")
def archive_rewritten(t):
    """SNK03: an archive of orders and customers, rewritten with some of the orders and with parts; customers are copied as they lie."""
    spark = t("orders").sparkSession
    trips = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("value"))
    routes = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("value"))
    where = storage.new_dir(spark, "archive")
    fs, at = storage.filesystem(f"{where}/first.zip")
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as out:
        export.write_archive({"trips": trips, "routes": routes}, {"trips": ["id"], "routes": ["id"]}, out)
    stops = t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("value"))
    export.rewrite_archive(f"{where}/first.zip", f"{where}/second.zip", {"trips": trips.filter("value = 'F'"), "stops": stops}, {"trips": ["id"], "stops": ["id"]})
    read = lambda name: sources.gtfs_table(spark, f"{where}/second.zip", name).select(F.lit(name).alias("kind"), F.col("fields")["id"].cast("long").alias("id"), F.col("fields")["value"].alias("value"))
    return read("trips").unionByName(read("routes")).unionByName(read("stops"))
