"""Queries of validation, placement and stages, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..operators import clusters as clusters_, curation, stages, validation
from .registry import query

WORKSPACES_SQL = """
with merges as (select distinct o_custkey as c, 'm' || o_orderkey as e, case when l_tax < 0.01 then 'group:g' || l_suppkey when l_discount > 0.095 then 'x' || l_suppkey else 'raw:' || l_partkey end as m from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'F'),
groups as (select distinct o_custkey as c, case when l_tax > 0.078 then 'm' else 'g' end || o_orderkey as e, case when l_linestatus = 'O' then 'merge:m' || o_orderkey when l_tax < 0.005 then 'group:g' || o_orderkey else 'raw:' || l_partkey end as m from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus <> 'F'),
nodes as (select o_custkey as c, 'g' || o_orderkey as e, 'n' || l_linenumber as n, 'raw:' || l_partkey as s from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus <> 'F' and l_quantity > 5),
times as (select o_custkey as c, 'g' || o_orderkey as e, 'n' || l_linenumber as a, 'n' || (l_linenumber + 1 + l_suppkey % 2) as b, case when l_quantity > 48 then -1 else cast(l_quantity as int) end as s from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus <> 'F'),
apart as (select distinct o_custkey as c, o_orderpriority as e, 'raw:' || o_orderkey as m from orders),
p as (select c, e, least(a, b) || '|' || greatest(a, b) as pair, s from times),
mi as (select distinct c, e from merges), gi as (select distinct c, e from groups), ids as (select distinct c, e, n from nodes),
ends as (select c, e, least(a, b) || '|' || greatest(a, b) as pair, unnest([a, b]) as n from times),
lost as (select distinct c, e, pair from ends where not exists (select 1 from ids where ids.c = ends.c and ids.e = ends.e and ids.n = ends.n)),
told as (select c, e, count(distinct pair) as told from p where not exists (select 1 from lost where lost.c = p.c and lost.e = p.e and lost.pair = p.pair) group by all),
said as (
select c, 'merges[' || e || ']' as path, 'two members at least' as rule from merges group by c, e having count(*) < 2
union all select c, 'groups[' || e || ']', 'two members at least' from groups group by c, e having count(*) < 2
union all select c, 'keep_separate_sets[' || e || ']', 'two members at least' from apart group by c, e having count(*) < 2
union all select c, 'merges[' || e || '].' || m, 'no reference' from merges where m like 'x%'
union all select c, 'merges[' || e || '].' || m, 'merges have raw members only' from merges where m like 'group:%'
union all select c, 'groups[' || e || '].' || m, 'groups have no group members' from groups where m like 'group:%'
union all select c, 'merges.' || m, 'one merge for each member' from merges where m like 'raw:%' group by c, m having count(*) > 1
union all select c, 'groups[' || e || ']', 'entity ids differ' from gi where (c, e) in (select c, e from mi)
union all select c, 'groups[' || e || '].' || m, 'known merges' from groups where m like 'merge:%' and (c, substr(m, 7)) not in (select c, e from mi)
union all select c, 'groups[' || e || ']', 'one node at least' from gi where (c, e) not in (select c, e from ids)
union all select c, 'groups[' || e || '].' || n, 'nodes are of members' from nodes where (c, e, s) not in (select c, e, m from groups)
union all select c, 'groups[' || e || '].' || n, 'node ids differ' from nodes group by c, e, n having count(*) > 1
union all select c, 'groups[' || e || '].' || s, 'nodes'' sources differ' from nodes group by c, e, s having count(*) > 1
union all select c, 'groups[' || e || '].' || pair, 'seconds from 0 on' from p where s < 0
union all select c, 'groups[' || e || '].' || pair, 'known nodes' from lost
union all select c, 'groups[' || e || '].' || pair, 'one time for each pair' from p group by c, e, pair having count(*) > 1
union all select c, 'groups[' || e || ']', 'a time for each pair' from (select c, e, count(*) as n from ids group by all) left join told using (c, e) where coalesce(told, 0) * 2 < n * (n - 1))
select c as cluster_key, path, rule from said
"""


@query(WORKSPACES_SQL)
def workspace_violations(t):
    """FIL15: orders of customers as merges and groups, their lines as members, nodes and times."""
    rows = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    key, o, part = F.col("o_custkey").alias("cluster_key"), F.col("o_orderkey"), F.concat(F.lit("raw:"), "l_partkey")
    done, open_ = rows.filter("o_orderstatus = 'F'"), rows.filter("o_orderstatus <> 'F'")
    g = F.concat(F.lit("g"), o)
    of_merge = F.when(F.col("l_tax") < 0.01, F.concat(F.lit("group:g"), "l_suppkey")).when(F.col("l_discount") > 0.095, F.concat(F.lit("x"), "l_suppkey")).otherwise(part)
    of_group = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("merge:m"), o)).when(F.col("l_tax") < 0.005, F.concat(F.lit("group:"), g)).otherwise(part)
    merges = done.select(key, F.concat(F.lit("m"), o).alias("entity_id"), of_merge.alias("member_ref"))
    groups = open_.select(key, F.concat(F.when(F.col("l_tax") > 0.078, "m").otherwise("g"), o).alias("entity_id"), of_group.alias("member_ref"))
    n = lambda x: F.concat(F.lit("n"), x)
    nodes = open_.filter("l_quantity > 5").select(key, g.alias("entity_id"), n(F.col("l_linenumber")).alias("node_id"), part.alias("source_ref"))
    times = open_.select(key, g.alias("entity_id"), n(F.col("l_linenumber")).alias("from_node"), n(F.col("l_linenumber") + 1 + F.col("l_suppkey") % 2).alias("to_node"), F.when(F.col("l_quantity") > 48, -1).otherwise(F.col("l_quantity").cast("int")).alias("seconds"))
    apart = t("orders").select(key, F.col("o_orderpriority").alias("set_id"), F.concat(F.lit("raw:"), o).alias("member_ref"))
    # each of the rules asks for them anew
    return validation.violations(*(storage.stored(x, "workspaces") for x in (merges, groups, nodes, times, apart)))


@query("""with i as (select o_custkey as k, o_orderkey as ref, lower(trim(o_orderpriority)) as name, case when coalesce(nullif(cast(floor(o_totalprice / 5000) as bigint), 0), 0) = 0 then 9999 else cast(floor(o_totalprice / 5000) as bigint) end as rank, case when o_orderstatus = 'F' then o_totalprice end as lat, case when o_orderstatus = 'F' then o_totalprice / 2 end as lon from orders),
near as (select a.k, a.ref, b.lat, b.lon, row_number() over (partition by a.k, a.ref order by abs(a.rank - b.rank), b.rank, b.ref) as n from i a join i b on a.k = b.k and a.name = b.name where a.lat is null and b.lat is not null),
placed as (select k, ref, avg(lat) as plat, avg(lon) as plon from near where n <= 2 group by all)
select i.k as cluster_key, i.ref, round(coalesce(lat, plat), 4) as lat, round(coalesce(lon, plon), 4) as lon, plat is not null as approx from i left join placed on placed.k = i.k and placed.ref = i.ref""")
def approximate_places(t):
    """FN42: a customer's orders of one priority by price; those of other states than F have no coordinates."""
    there = F.col("o_orderstatus") == "F"
    items = t("orders").select(F.col("o_custkey").alias("cluster_key"), F.col("o_orderkey").alias("ref"), F.col("o_orderpriority").alias("display_name"), F.floor(F.col("o_totalprice") / 5000).alias("rank"), F.when(there, F.col("o_totalprice")).alias("lat"), F.when(there, F.col("o_totalprice") / 2).alias("lon"))
    return curation.approximate_places(items).select("cluster_key", "ref", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "approx")


@query("""with a as (select * from orders where not (o_orderpriority like '1%' and o_orderstatus = 'F') and o_orderpriority not like '5%'), b as (select * from orders where o_orderpriority not like '2%')
select coalesce(a.p, b.p) as scope, case when a.p is null then 'new' when b.p is null then 'gone' when a.n = b.n then 'same' else 'changed' end as change, b.n as n_rows, round(b.total, 2) as total
from (select o_orderpriority as p, count(*) as n from a group by 1) a full join (select o_orderpriority as p, count(*) as n, sum(o_totalprice) as total from b group by 1) b on a.p = b.p""")
def stage_rebuilt(t):
    """PIP09, SNK04: sums of orders by priority, run over some orders and then over others; what the second run made anew, and the result."""
    rows = t("orders").select(F.col("o_orderpriority").alias("scope"), "o_orderkey", "o_orderstatus", "o_totalprice")
    spark = rows.sparkSession
    stage = stages.Stage(spark, storage.new_dir(spark, "stage"), ["scope"], "1")
    summed = lambda x: x.groupBy("scope").agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    stage.run(rows.filter("not (scope like '1%' and o_orderstatus = 'F') and scope not like '5%'"), summed)
    found = stage.run(rows.filter("scope not like '2%'"), summed)
    return found.join(stage.result(), "scope", "left")


@query("""with c as (select c_custkey as k, case when c_acctbal > 7000 then 'high' when c_acctbal > 0 then 'medium' else 'low' end as severity, case when c_nationkey < 20 then 'open' else 'resolved' end as status, c_acctbal, c_nationkey from customer),
w as (select o_custkey as k, max(o_orderkey) as version from orders where o_orderstatus = 'P' group by 1),
first as (select c.*, w.k is not null as has, version from c left join w using (k) order by case severity when 'high' then 1 when 'medium' then 2 else 3 end, c_acctbal desc, k limit 300)
select k as cluster_key, severity, case when has and status = 'open' then 'in_review' else status end as effective_status, has as has_workspace, version as workspace_version, coalesce((select string_agg(o_orderkey || '', ',' order by floor(o_totalprice / 10000), o_orderkey) from orders where o_custkey = k), '') as candidates from first""")
def cluster_list(t):
    """PIP17: customers as clusters, their orders as candidates; the first 300."""
    balance = F.col("c_acctbal")
    clusters = t("customer").select(F.col("c_custkey").alias("cluster_key"), F.when(F.col("c_nationkey") < 20, "open").otherwise("resolved").alias("status"), F.when(balance > 7000, "high").when(balance > 0, "medium").otherwise("low").alias("severity"), balance.alias("updated_at"))
    workspaces = t("orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("cluster_key")).agg(F.max("o_orderkey").alias("version"))
    found = clusters_.cluster_list(clusters, workspaces, _candidates(t), limit=300)
    return found.select("cluster_key", "severity", "effective_status", "has_workspace", "workspace_version", F.array_join(F.transform("candidates", lambda x: x["station_id"].cast("string")), ",").alias("candidates"))


def _candidates(t):
    return t("orders").select(F.col("o_custkey").alias("cluster_key"), F.col("o_orderkey").alias("station_id"), F.floor(F.col("o_totalprice") / 10000).alias("rank"), F.col("o_orderpriority").alias("display_name"))


@query("""with p as (select o_custkey as k, o_orderkey as id, floor(o_totalprice / 10000) as rank, coalesce((select string_agg(distinct l_suppkey || '', ',' order by l_suppkey || '') from lineitem where l_orderkey = o_orderkey and l_returnflag <> 'R'), '') as active, coalesce((select string_agg(distinct l_suppkey || '', ',' order by l_suppkey || '') from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R'), '') as past from orders)
select c_custkey as cluster_key, c_name as name, coalesce((select string_agg(id || ':' || active || ':' || past, ';' order by rank, id) from p where k = c_custkey), '') as candidates, (select count(*) from events where user_id = c_custkey) as n_events, coalesce((select string_agg(event_id || '', ',' order by ts, event_id) from events where user_id = c_custkey and event_type = 'purchase'), '') as purchases from customer""")
def cluster_documents(t):
    """PIP17, JON18: customers with their orders, each with what its lines say, and their events, in one aggregation."""
    mappings = t("lineitem").select(F.col("l_orderkey").alias("station_id"), F.col("l_suppkey").cast("string").alias("source_id"), F.col("l_partkey").alias("ref"), (F.col("l_returnflag") != "R").alias("is_active"))
    known = clusters_.provenance(_candidates(t), mappings)
    events = t("events").select(F.col("user_id").alias("cluster_key"), "ts", "event_id", "event_type")
    found = clusters_.cluster_documents(t("customer").select(F.col("c_custkey").alias("cluster_key"), "c_name"), candidates=(known, ["rank", "station_id"]), events=(events, ["ts", "event_id"]))
    joined = lambda c: F.array_join(c, ",")
    told = F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x["station_id"].cast("string"), joined(x["active_source_ids"]), joined(x["historical_source_ids"]))), ";")
    bought = joined(F.transform(F.filter("events", lambda x: x["event_type"] == "purchase"), lambda x: x["event_id"].cast("string")))
    return found.select("cluster_key", F.col("c_name").alias("name"), told.alias("candidates"), F.size("events").cast("long").alias("n_events"), bought.alias("purchases"))
