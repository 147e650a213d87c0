"""Queries of the pipelines over derived tables: stations, merge queue, references, network, export, feeds, curation, evaluation."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from .. import storage
from ..operators import curation, decisions, evaluation, export, feed, graph, merge_queue, network, references, stations as st
from . import standins as s
from .registry import query

_CLOSE = """reach as (select a as x, b as y from (select a, b from edges union select b, a from edges)), walk(x, y) as (select x, x from reach union select w.x, r.y from walk w join reach r on r.x = w.y), comp as (select x as id, min(y) as component from walk group by 1)"""


@query()
def graph_components(t):
    """GRF01. Orders (even numbers) and parts (odd ones) that lines connect. A recursive walk in SQL would be too slow on all lines; tests hold it against brute force."""
    e = t("lineitem").select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"))
    return graph.components(e).withColumnRenamed("node", "id")


@query("with recursive tree as (select p_partkey as child, p_partkey // 3 as parent from part where p_size > 1), walk(id) as (select p_partkey from part where p_size = 50 union select case when c.child = w.id then c.parent else c.child end from walk w join tree c on c.child = w.id or c.parent = w.id) select distinct id from walk")
def graph_closure(t):
    """GRF02."""
    tree = t("part").filter("p_size > 1").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).cast("long").alias("parent"))
    return graph.closure(t("part").filter("p_size = 50").select(F.col("p_partkey").alias("id")), tree)


_XY = "select p_partkey as id, p_name || (p_size % 3) as name, (p_partkey * 7919 % 30011) * 1.0 as x, (p_partkey * 104729 % 5003) * 1.0 as y from part"


@query(f"with recursive p as ({_XY}), edges as (select a.id as a, b.id as b from p a join p b on a.name = b.name and a.id < b.id and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 500), {_CLOSE} select p.id, coalesce(component, p.id) as cluster from p left join comp using (id)")
def graph_eps_clusters(t):
    """WIN06, GRF03."""
    k = F.col("p_partkey")
    p = t("part").select(k.alias("id"), F.concat("p_name", (F.col("p_size") % 3).cast("string")).alias("name"), (k * 7919 % 30011).cast("double").alias("x"), (k * 104729 % 5003).cast("double").alias("y"))
    return graph.eps_clusters(p)


def _spread(rows: str, by: str, prefix: str) -> str:
    d = s.haversine("m.lat", "m.lon", "c.clat", "c.clon")
    return f"{prefix}_c as (select {by}, avg(lat) as clat, avg(lon) as clon, count(*) as n from {rows} where lat is not null group by 1), {prefix} as (select c.{by}, any_value(clat) as lat, any_value(clon) as lon, any_value(n) as n, max({d}) as spread from {rows} m join {prefix}_c c using ({by}) where m.lat is not null group by 1)"


def _peers(key: str, prefix: str) -> str:
    d = s.haversine("o.lat", "o.lon", "c.clat", "c.clon")
    return f"""{prefix}_o as (select a.ref, o.lat, o.lon from places a join places o on a.{key} = o.{key} and a.ref <> o.ref where o.lat is not null), {prefix}_c as (select ref, avg(lat) as clat, avg(lon) as clon, count(*) as n from {prefix}_o group by 1),
{prefix} as (select c.ref, any_value(clat) as lat, any_value(clon) as lon, any_value(n) as n, max({d}) as spread from {prefix}_o o join {prefix}_c c using (ref) group by 1)"""


_AWAY = {p: f"case when source <> '{p}' then {s.haversine('rlat', 'rlon', f'{p}_lat', f'{p}_lon')} end" for p in ("parent", "points", "siblings", "topo")}
_RESOLVED = f"""{s.PLACES}, {s.POINTS}, {_spread("points", "place_ref", "pts")}, {_peers("parent_ref", "sib")}, {_peers("topo_ref", "top")},
ev as (select p.*, q.lat as parent_lat, q.lon as parent_lon, pts.lat as points_lat, pts.lon as points_lon, pts.n as points_n, sib.lat as siblings_lat, sib.lon as siblings_lon, sib.n as siblings_n, sib.spread as siblings_spread, top.lat as topo_lat, top.lon as topo_lon, top.n as topo_n, top.spread as topo_spread
  from places p left join places q on q.ref = p.parent_ref left join pts on pts.place_ref = p.ref left join sib on sib.ref = p.ref left join top on top.ref = p.ref),
src as (select *, case when lat is not null then 'self' when parent_lat is not null and points_lat is not null then case when {s.haversine("parent_lat", "parent_lon", "points_lat", "points_lon")} <= 250 or (points_n >= 2 and {s.haversine("parent_lat", "parent_lon", "points_lat", "points_lon")} > 75) then 'points' else 'parent' end
  when parent_lat is not null then 'parent' when points_lat is not null then 'points' when siblings_n >= 2 and siblings_spread <= 1000 then 'siblings' when topo_n >= 2 and topo_spread <= 1500 then 'topo' else 'missing' end as source from ev),
placed as (select *, case source when 'self' then lat when 'parent' then parent_lat when 'points' then points_lat when 'siblings' then siblings_lat when 'topo' then topo_lat end as rlat, case source when 'self' then lon when 'parent' then parent_lon when 'points' then points_lon when 'siblings' then siblings_lon when 'topo' then topo_lon end as rlon from src),
signals as (select *, {" + ".join(f"case when {d} <= 250 then 1 else 0 end" for d in _AWAY.values())} as supports, {" + ".join(f"case when {d} > 1000 then 1 else 0 end" for d in _AWAY.values())} as conflicts, greatest({", ".join(f"coalesce({d}, 0.0)" for d in _AWAY.values())}) as far from placed),
resolved as (select *, case when source = 'missing' then 'unresolved' when source = 'self' then 'high' when source in ('parent', 'points') then case when supports >= 1 then 'high' when conflicts = 0 then 'medium' else 'low' end when source = 'siblings' then 'medium' else 'low' end as confidence from signals)"""


@query(f"with {_RESOLVED} select id, source as coord_source, round(rlat, 6) as lat, round(rlon, 6) as lon, cast(supports as int) as supports, cast(conflicts as int) as conflicts, round(far, 3) as max_signal_m, confidence from resolved")
def coord_resolution(t):
    """JON02-JON05, JON16, JON17, AGG10, FN19."""
    r = st.resolved(st.coordinate_evidence(s.places(t), s.points(t)))
    return r.select("id", "coord_source", F.round("rlat", 6).alias("lat"), F.round("rlon", 6).alias("lon"), "supports", "conflicts", F.round("max_signal_m", 3).alias("max_signal_m"), "confidence")


_NORMAL = r"trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g'))"
_PROJECTED = f"select id, {_NORMAL} as name, 6378137 * radians(rlon) as x, 6378137 * ln(tan(pi() / 4 + radians(rlat) / 2)) as y from resolved where hard_id = '' and rlat is not null"


@query(
    f"""with recursive {_RESOLVED}, p as ({_PROJECTED}), edges as (select a.id as a, b.id as b from p a join p b on a.name = b.name and a.id < b.id and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 500), {_CLOSE},
numbered as (select p.id, dense_rank() over (partition by p.name order by coalesce(component, p.id)) - 1 as number from p left join comp using (id)),
grouped as (select r.*, case when hard_id <> '' then 'gstn_' || substr(md5('hard|' || hard_id), 1, 24) when number is not null then 'gstn_' || substr(md5('geo|' || {_NORMAL} || '|' || number), 1, 24) else 'gstn_' || substr(md5('name|' || {_NORMAL}), 1, 24) end as station_id from resolved r left join numbered using (id))
select station_id, min(name) as name, min(country) as country, round(avg(rlat), 6) as lat, round(avg(rlon), 6) as lon, count(*) as members, cast(sum(conflicts) as bigint) as conflicts,
case when bool_or(confidence = 'unresolved') then 'unresolved' when bool_or(confidence = 'low') then 'low' when bool_or(confidence = 'medium') then 'medium' else 'high' end as confidence from grouped group by 1"""
)
def station_groups(t):
    """PIP02, WIN06, AGG12, AGG25."""
    _, found = st.build(s.places(t), s.points(t))
    return found.select("station_id", "name", "country", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "members", "conflicts", "confidence")


@query(f"with {s.POINTS} select a.place_ref // 3 as station_id, a.point_id as from_id, b.point_id as to_id, cast(greatest(30, least(900, round_even({s.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 1.25, 0))) as int) as seconds from points a join points b on a.place_ref // 3 = b.place_ref // 3 and a.point_id <> b.point_id")
def transfer_edges(t):
    """JON14, JON21, FN14, GRF05."""
    return st.transfer_edges(s.points(t).withColumn("station_id", F.floor(F.col("place_ref") / 3).cast("long")))


_PREP = f"prep as (select *, {s.loose('name')} as loose, {s.grams(s.loose('name'))} as grams, list_sort(list_distinct(list_filter(string_split({s.loose('name')}, ' '), lambda w: w <> ''))) as tokens, 6378137 * radians(lon) as x, 6378137 * ln(tan(pi() / 4 + radians(lat) / 2)) as y from stations)"
_PLANAR = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))"
_SIM = s.similarity("a.grams", "b.grams")
_SEEDS = f"""{s.STATIONS}, {_PREP}, tok as (select id, country, unnest(tokens) as token from prep), df as (select country, token, count(*) as df from tok group by 1, 2), rare as (select * from tok join df using (country, token) where df between 2 and 64),
rarest as (select id, country, token from (select *, row_number() over (partition by id order by df, token) as k from rare) where k = 1),
exact as (select a.id as a, b.id as b, 'exact_name' as reason from prep a join prep b on a.loose = b.loose and a.id < b.id where {_PLANAR} <= 5000 or ({_PLANAR} is null and a.country is not null and a.country = b.country) or (a.country is not null and a.country = b.country and list_has_any(a.sources, b.sources) and {_SIM} >= 0.92)),
geo as (select distinct a.id as a, b.id as b, 'loose_name_geo' as reason from rare p join rare q on p.country = q.country and p.token = q.token and p.id < q.id join prep a on a.id = p.id join prep b on b.id = q.id where {_PLANAR} <= 1500 and {_SIM} >= 0.72),
lost as (select distinct a.id as a, b.id as b, 'loose_name_missing_coords' as reason from (select least(p.id, q.id) as i, greatest(p.id, q.id) as j from rarest p join prep n on n.id = p.id and n.lat is null join rare q on q.country = p.country and q.token = p.token and q.id <> p.id) join prep a on a.id = i join prep b on b.id = j where {_PLANAR} is null and {_SIM} >= 0.88),
seeds as (select * from exact union select * from geo union select * from lost)"""


@query(f"with {_SEEDS} select * from seeds")
def pair_seeds(t):
    """JON09-JON11, WIN04, AGG16, SET07."""
    return merge_queue.seeds(merge_queue.prepared(s.stations(t)))


_METRICS = f"""{{name}} as (select {{keys}}, a.id as a, b.id as b, a.loose as la, b.loose as lb, a.country as ca, b.country as cb, a.lat as alat, b.lat as blat, round({_SIM}, 4) as sim, {_PLANAR} as planar, {s.haversine("a.lat", "a.lon", "b.lat", "b.lon")} as d, a.loose = b.loose as same, a.country = b.country as same_country, len(list_intersect(a.sources, b.sources)) as shared, round({s.similarity("a.tokens", "b.tokens")}, 4) as jac
  from {{pairs}} k join prep a on a.id = k.a join prep b on b.id = k.b)"""
_GENERIC = r"regexp_matches({0}, '^(steig|gleis|platform|plattform|quai|bussteig|bahnsteig)( [a-z0-9]+)?$')"
_ELIGIBLE = f"""{_SEEDS}, seeded as (select distinct a, b from seeds), {_METRICS.format(name="m", keys="1 as one", pairs="seeded")},
eligible as (select a, b, sim from m where ((same and (planar <= 5000 or (planar is null and same_country) or (same_country and shared > 0 and sim >= 0.92))) or (sim >= 0.72 and planar <= 1500) or (sim >= 0.88 and same_country and planar is null))
  and not (({_GENERIC.format("la")} or {_GENERIC.format("lb")}) and shared = 0 and coalesce(d, 999999) > 250))"""


@query(f"with {_ELIGIBLE} select a, b, round(sim, 4) as similarity from eligible")
def eligible_pairs(t):
    """FIL08, JON15, JON23."""
    return merge_queue.eligible_pairs(merge_queue.prepared(s.stations(t)), "similarity")


_THREE = "case when {x} >= {hi} then 'supporting' when {x} >= {lo} then 'informational' else 'warning' end"
_GEN = f"({_GENERIC.format('la')} or {_GENERIC.format('lb')} or fa.n >= 12 or fb.n >= 12)"
_SIDES = "((alat is not null)::int + (blat is not null)::int)"
_EVIDENCE = f"""{_ELIGIBLE}, edges as (select a, b from eligible), {_CLOSE}, members as (select id, md5(string_agg(cast(id as varchar), ',' order by cast(id as varchar)) over (partition by component)) as cluster_key_, component from comp),
keyed as (select component, md5(string_agg(cast(id as varchar), ',' order by cast(id as varchar))) as cluster_key, count(*) as candidates from comp group by 1 having count(*) > 1),
pairs as (select k.cluster_key, p.id as a, q.id as b from comp p join comp q on p.component = q.component and p.id < q.id join keyed k on k.component = p.component), {_METRICS.format(name="cm", keys="k.cluster_key", pairs="pairs")},
freq as (select loose, count(*) as n from prep group by 1),
ev as (select cluster_key, a, b, unnest([
  {{'type': 'name_exact', 'status': case when same then 'supporting' else 'informational' end, 'score': case when same then 1.0 else 0.0 end::double}},
  {{'type': 'name_loose_similarity', 'status': {_THREE.format(x="sim", hi=0.92, lo=0.72)}, 'score': sim::double}}, {{'type': 'token_overlap', 'status': {_THREE.format(x="jac", hi=0.75, lo=0.4)}, 'score': jac::double}},
  {{'type': 'geographic_distance', 'status': case when d is null then 'missing' when d <= 250 then 'supporting' when d <= 1000 then 'informational' else 'warning' end, 'score': case when d is null then 0 when d <= 50 then 1 when d <= 250 then 0.85 when d <= 1000 then 0.6 when d <= 5000 then 0.25 else 0.05 end::double}},
  {{'type': 'coordinate_quality', 'status': case {_SIDES} when 2 then 'supporting' when 1 then 'informational' else 'missing' end, 'score': case {_SIDES} when 2 then 1 when 1 then 0.5 else 0 end::double}},
  {{'type': 'shared_provider_sources', 'status': case when shared > 0 then 'supporting' else 'informational' end, 'score': case when shared >= 2 then 1 when shared = 1 then 0.65 else 0 end::double}},
  {{'type': 'shared_route_context', 'status': 'informational', 'score': 0::double}}, {{'type': 'shared_adjacent_stations', 'status': 'informational', 'score': 0::double}},
  {{'type': 'country_relation', 'status': case when same_country = true then 'supporting' when same_country = false then 'informational' else 'missing' end, 'score': case when same_country = true then 1 when same_country = false then 0.6 else 0 end::double}},
  {{'type': 'generic_name_penalty', 'status': case when {_GEN} then 'warning' else 'informational' end, 'score': case when {_GEN} then 0.15 else 1 end::double}}]) as e from cm join freq fa on fa.loose = la join freq fb on fb.loose = lb),
evidence as (select cluster_key, a, b, e.type as type, e.status as status, round(e.score, 4) as score from ev)"""


@query(f"with recursive {_EVIDENCE} select * from evidence")
def cluster_evidence(t):
    """JON13, SET05, FN09, FN13, FN20."""
    return merge_queue.build(s.stations(t))["evidence"]


@query(
    f"""with recursive {_EVIDENCE}, agg as (select cluster_key, count(*) filter (status = 'warning') as warnings, count(*) filter (status = 'missing') as missing, count(distinct case when status in ('warning', 'missing') then {{'a': a, 'b': b}} end) as issue_count, bool_or(type = 'generic_name_penalty' and status = 'warning') as generic from evidence group by 1), far as (select cluster_key, max(d) as far from cm group by 1)
select cluster_key, candidates, warnings, missing, issue_count, round(far, 3) as max_distance, case when candidates >= 4 or warnings >= 4 or missing >= 4 or coalesce(far, 0) > 5000 or generic then 'high' when candidates = 3 or warnings > 0 or missing > 0 or coalesce(far, 0) > 1000 then 'medium' else 'low' end as severity
from keyed join agg using (cluster_key) join far using (cluster_key)"""
)
def cluster_severity(t):
    """PIP05, GRF01, AGG02, AGG03, AGG11."""
    return merge_queue.build(s.stations(t))["clusters"].withColumn("max_distance", F.round("max_distance", 3))


@query(
    f"""with recursive {_EVIDENCE} select cluster_key, a, b, count(*) filter (status = 'supporting') as supporting, count(*) filter (status = 'informational') as informational, count(*) filter (status = 'warning') as warning, count(*) filter (status = 'missing') as missing,
array_to_string(list_sort(list(type) filter (status = 'supporting'))[1:4], ',') as highlights, count(*) filter (type in ('coordinate_quality', 'generic_name_penalty')) as risk_rows from evidence group by 1, 2, 3"""
)
def evidence_summary(t):
    """AGG17, FN36."""
    return merge_queue.build(s.stations(t))["summaries"].drop("mean_score")


#: Beginnings of names in other scripts, with marks, ligatures and abbreviations, for stations and references.
_SPELLED = ("", "Αθήνα ", "Київ-", "Straße Bf ", "Éire: ")


def _spelled(k, name):
    return F.concat(F.element_at(F.array(*map(F.lit, _SPELLED)), (k % 5 + 1).cast("int")), name)


def _references(t):
    """All parts as stations, and all of them again as references some way off, a seventh under another spelling, a fifth without coordinates."""
    k = F.col("id")
    rows = s.stations(t).drop("sources")
    refs = rows.select(
        (k + 10_000_000_000).alias("id"), _spelled(k + F.when(k % 7 == 0, 1).otherwise(0), F.col("name")).alias("name"), "country", F.when(k % 5 != 0, F.col("lat") + k % 7 / 1000.0).alias("lat"), F.when(k % 5 != 0, F.col("lon")).alias("lon"),
        (k % 2).alias("source_id"), F.when(k % 3 == 0, "shop").otherwise("station").alias("category"),
    )
    return rows.withColumn("name", _spelled(k, F.col("name"))), refs


_NEARNESS = s.haversine("a.lat", "a.lon", "b.lat", "b.lon")
_LIST = "[" + ", ".join(f"'{x}'" for x in _SPELLED) + "]"
# names by letters and digits of any script; loosely also without accents and ligatures; nothing is abbreviated or written out
_PLAIN, _LOOSE = (f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))" for x in ("lower(name)", "replace(strip_accents(lower(name)), 'ß', 'ss')"))
_FORMS = f"{_LOOSE} as loose, {_PLAIN} as plain, {s.grams(_LOOSE)} as g, {s.grams(_PLAIN)} as gp, list_distinct(list_filter(string_split({_LOOSE}, ' '), lambda x: x <> '')) as w"
_RSIM = f"round(greatest({s.similarity('a.g', 'b.g')}, {s.similarity('a.gp', 'b.gp')}), 6)"
_MATCHES = f"""{s.STATIONS}, sp as (select *, {_FORMS} from (select * replace ({_LIST}[id % 5 + 1] || name as name) from stations)),
rp as (select *, {_FORMS} from (select id + 10000000000 as id, {_LIST}[(id + case when id % 7 = 0 then 1 else 0 end) % 5 + 1] || name as name, country, case when id % 5 <> 0 then lat + (id % 7) / 1000.0 end as lat, case when id % 5 <> 0 then lon end as lon, id % 2 as source_id, case when id % 3 = 0 then 'shop' else 'station' end as category from stations)),
cand as (select a.id as station, b.id as reference, b.source_id, {_NEARNESS} as distance, {_RSIM} as similarity, len(list_intersect(a.w, b.w)) as overlap, a.plain = b.plain as eq, case when category = 'shop' then 0.7 else 1.0 end as cat
  from sp a join rp b on a.country is not distinct from b.country where {_NEARNESS} <= 1500 or ({_NEARNESS} is null and (a.loose = b.loose or a.plain = b.plain or {s.similarity('a.g', 'b.g')} >= 0.72))),
scored as (select *, round(least(greatest(similarity, 0), 1) * 0.55::double + least(overlap / 4, 1) * 0.15::double + case when distance is null and eq then 0.20 when distance is null then 0.08 when distance <= 50 then 0.20 when distance <= 250 then 0.18 when distance <= 500 then 0.14 when distance <= 1000 then 0.09 when distance <= 1500 then 0.04 else 0 end::double + cat::double * 0.10::double, 4) as confidence,
  case when (eq and distance <= 250) or (similarity >= 0.97 and coalesce(distance, 0) <= 100) then 'strong' when (similarity >= 0.87 and distance <= 500) or (distance is null and (eq or similarity >= 0.92) and overlap >= 1) then 'probable' when (overlap >= 1 and distance <= 1000) or (distance is null and similarity >= 0.80 and overlap >= 1) then 'weak' end as status from cand),
matches as (select * from (select *, row_number() over (partition by station, source_id order by confidence desc, coalesce(distance, 1e12), similarity desc, reference) as rank from scored where status is not null) where rank <= 3)"""


@query(f"with {_MATCHES} select station, reference, source_id, round(distance, 3) as distance, similarity, confidence, status, rank from matches")
def reference_matches(t):
    """PIP04, JON12, WIN05, FN16-FN18."""
    found = references.matches(*_references(t))
    return found.select("station", "reference", "source_id", F.round("distance", 3).alias("distance"), "similarity", "confidence", "status", "rank")


@query(f"with {_MATCHES} select station, count(distinct source_id) as sources, count(*) filter (rank = 1) as primaries, count(*) filter (status = 'strong') as strong, count(*) filter (status = 'probable') as probable from matches group by 1")
def reference_summary(t):
    """AGG19."""
    return references.match_summary(references.matches(*_references(t)))


def _routes(t):
    return t("lineitem").select((F.col("l_suppkey") % 10).alias("source_id"), F.col("l_partkey").alias("ref"), (F.col("l_orderkey") % 30).cast("string").alias("label"), F.col("l_returnflag").alias("mode"), F.lit(1).alias("hits"))


@query(f"with {s.MAPPINGS}, r as (select station_id, l_returnflag || '|' || (l_orderkey % 30) as route_key, count(*) as hits from lineitem join mappings on source_id = l_suppkey % 10 and ref = l_partkey where is_active group by 1, 2) select station_id, route_key, hits from (select *, row_number() over (partition by station_id order by hits desc, route_key) as k from r) where k <= 8")
def network_routes(t):
    """PIP03, AGG01, SRT02."""
    from ..operators.select import top_per_group

    return top_per_group(network.projected_routes(_routes(t), s.mappings(t)), ["station_id"], [F.desc("hits"), F.col("route_key")], 8)


@query(
    f"""with {s.MAPPINGS}, steps as (select l_suppkey % 10 as source_id, l_partkey as f, l_partkey + 1 as g from lineitem), both_ as (select a.station_id as x, b.station_id as y from steps join mappings a on a.source_id = steps.source_id and a.ref = f and a.is_active join mappings b on b.source_id = steps.source_id and b.ref = g and b.is_active where a.station_id <> b.station_id)
select station_id, neighbour, direction, count(*) as hits from (select x as station_id, y as neighbour, 'out' as direction from both_ union all select y, x, 'in' from both_) group by 1, 2, 3"""
)
def network_adjacency(t):
    """GRF04, JON24."""
    steps = t("lineitem").select((F.col("l_suppkey") % 10).alias("source_id"), F.col("l_partkey").alias("from_ref"), (F.col("l_partkey") + 1).alias("to_ref"), F.lit(1).alias("hits"))
    return network.projected_adjacency(steps, s.mappings(t))


def _trips(t):
    mode = F.when(F.col("o_orderkey") % 4 == 0, "tram").when(F.col("o_orderkey") % 4 == 1, "bus").otherwise("rail")
    return t("orders").select(F.col("o_orderkey").alias("trip_id"), (F.col("o_orderkey") % 100).cast("string").alias("route_id"), mode.alias("mode"), F.when(F.col("o_orderkey") % 3 == 0, "ICE").otherwise("").alias("short_name"), F.lit("").alias("long_name"), F.col("o_orderpriority").alias("headsign"), F.lit("DE").alias("country"), F.col("o_orderkey").alias("seq"))


@query(
    """with x as (select o_orderkey as k, cast(o_orderkey % 100 as varchar) as route_id, case o_orderkey % 4 when 0 then 'tram' when 1 then 'bus' else 'rail' end as mode, case when o_orderkey % 3 = 0 then 'ICE' else '' end as short from orders), l as (select * from (select *, row_number() over (partition by route_id order by k desc) as n from x) where n = 1)
select route_id, 'agency_de' as agency_id, coalesce(nullif(short, ''), route_id) as route_short_name, case mode when 'tram' then '0' when 'bus' then '3' else '2' end as route_type, 'tier:' || case when short = 'ICE' then 'high-speed' when mode in ('tram', 'bus') then 'local' else 'regional' end as route_desc from l"""
)
def export_routes(t):
    """PIP06, SET12, FN21, FN23, SNK02."""
    return export.routes(_trips(t)).drop("route_long_name")


def _stop_times(t):
    clock = F.when(F.col("l_linenumber") % 2 == 0, F.format_string("%02d:%02d:00", (F.col("l_quantity") / 2).cast("int"), F.col("l_linenumber")))
    seq = F.col("l_linenumber").cast("long") * 100000000 + F.col("l_quantity").cast("long") * 100000 + F.col("l_partkey")
    return t("lineitem").select(F.col("l_orderkey").alias("trip_id"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("stop_id"), seq.alias("stop_sequence"), clock.alias("arrival_time"), F.lit(None).cast("string").alias("departure_time"))


@query(
    """with x as (select l_orderkey as trip_id, l_partkey || '-' || l_suppkey as stop_id, cast(l_linenumber as bigint) * 100000000 + cast(l_quantity as bigint) * 100000 + l_partkey as s, case when l_linenumber % 2 = 0 then printf('%02d:%02d:00', cast(floor(l_quantity / 2) as int), l_linenumber) end as t from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal > 0)),
y as (select *, row_number() over (partition by trip_id order by s, stop_id) as k, count(*) over (partition by trip_id) as n from x)
select trip_id, cast(k as bigint) as stop_sequence, stop_id, coalesce(t, printf('%02d:%02d:00', 6 + ((k - 1) * 5) // 60, ((k - 1) * 5) % 60)) as arrival_time from y where n >= 2"""
)
def export_stop_times(t):
    """WIN14, FN24, JON20, SRT08."""
    known = t("supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    stops = t("lineitem").join(known, "l_suppkey", "left_semi").select(F.concat_ws("-", "l_partkey", "l_suppkey").alias("stop_id"))
    return export.trip_rows(_stop_times(t), stops).select("trip_id", "stop_sequence", "stop_id", "arrival_time")


@query(
    """select 'trips_route' as relation, count(*) as dangling from orders o where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 0) union all select 'stop_times_trip', count(*) from lineitem l where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'P') or l_orderkey is null
union all select 'stop_times_stop', count(*) from lineitem where not exists (select 1 from part where p_partkey = l_partkey and p_size > 5) union all select 'trips_without_stop_times', count(*) from orders o where not exists (select 1 from lineitem where l_orderkey = o_orderkey)"""
)
def integrity_checks(t):
    """JON25, PIP20."""
    tables = {
        "routes": t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("route_id")), "stops": t("part").filter("p_size > 5").select(F.col("p_partkey").alias("stop_id")),
        "trips": t("orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("route_id"), "o_orderstatus"), "stop_times": t("lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("stop_id")),
    }
    found = export.integrity(tables)
    # trips of status P count as absent here, so that one relation has rows that fail
    part = export.integrity({"trips": tables["trips"].filter("o_orderstatus <> 'P'"), "stop_times": tables["stop_times"]}).filter("relation = 'stop_times_trip'")
    return found.filter("relation <> 'stop_times_trip'").unionByName(part)


@query("select o_orderkey % 50 as service, count(*) as stops from lineitem join orders on o_orderkey = l_orderkey where l_partkey % 3 = 0 and o_orderkey in (select l_orderkey from lineitem where l_partkey % 3 = 0 group by 1 having count(*) >= 2) group by 1")
def feed_trips_in_scope(t):
    """PIP07."""
    times = t("lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("stop_id"))
    scope = t("part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("stop_id"))
    kept = times.join(feed.trips_in(times, scope), "trip_id", "left_semi").join(scope, "stop_id", "left_semi")
    return kept.groupBy((F.col("trip_id") % 50).alias("service")).agg(F.count("*").alias("stops"))


@query(
    """with cal as (select l_partkey as feed, l_orderkey as service_id, l_shipdate::date as s, l_shipdate::date + 30 as e, l_suppkey as bits from lineitem), days as (select unnest(range(timestamp '1998-05-01', timestamp '1998-05-22', interval 1 day))::date as d),
exc as (select l_partkey as feed, l_orderkey as service_id, l_shipdate::date + 5 as d, case when l_quantity > 25 then 2 else 1 end as type, row_number() over (partition by l_partkey, l_orderkey, l_shipdate::date order by l_linenumber desc) as k from lineitem),
base as (select distinct feed, service_id, d from cal, days where d between s and e and (bits >> (isodow(d) - 1)) & 1 = 1),
act as (select feed, d from base b where not exists (select 1 from exc x where k = 1 and type = 2 and x.feed = b.feed and x.service_id = b.service_id and x.d = b.d) union select feed, exc.d from exc join days using (d) where k = 1 and type = 1)
select feed, coalesce(first_day, start)::varchar as day from (select feed, min(s) as start from cal group by 1) left join (select feed, min(d) as first_day from act group by 1) using (feed)"""
)
def feed_active_date(t):
    """FN26, FN27. Parts are feeds, their orders services that run for 30 days on weekdays by the supplier's number, with an exception on the sixth."""
    line = t("lineitem").select(F.col("l_partkey").alias("feed"), F.col("l_orderkey").alias("service_id"), F.col("l_shipdate").cast("date").alias("start_date"), "l_suppkey", "l_linenumber", "l_quantity", F.date_add(F.col("l_shipdate").cast("date"), 5).alias("date"))
    names = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    calendar = line.select("feed", "service_id", "start_date", F.date_add("start_date", 30).alias("end_date"), *(F.pmod(F.shiftright("l_suppkey", k), F.lit(2)).alias(n) for k, n in enumerate(names)))
    exceptions = line.select("feed", "service_id", "date", F.when(F.col("l_quantity") > 25, 2).otherwise(1).alias("type"), F.col("l_linenumber").alias("seq"))
    return feed.active_date(calendar, exceptions, F.lit("1998-05-01").cast("date"), by=("feed",)).withColumn("day", F.col("day").cast("string"))


@query("select trip_id, first, last from (select *, row_number() over (partition by first, last order by trip_id) as k from (select l_orderkey as trip_id, arg_min(l_suppkey, s) as first, arg_max(l_suppkey, s) as last from (select *, l_linenumber * 1000000 + l_partkey as s from lineitem) group by 1) where first <> last) where k = 1 order by trip_id limit 6")
def feed_test_queries(t):
    """PIP08, SRT10, WIN12."""
    return feed.test_queries(t("lineitem").select(F.col("l_orderkey").alias("trip_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("stop_sequence"), F.col("l_suppkey").alias("stop_id")))


def _decisions(t):
    return t("orders").select(F.col("o_custkey").alias("cluster_key"), F.col("o_orderkey").alias("decision_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("verdict"))


@query("select cluster_key, decision_id, verdict from (select o_custkey as cluster_key, o_orderkey as decision_id, o_orderstatus as verdict, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)) where k = 1")
def publish_latest(t):
    """PIP15, WIN09."""
    return curation.published(t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("cluster_key")), _decisions(t)).select("cluster_key", "decision_id", "verdict")


@query("select user_id as cluster_key, 'workspace' as kind, cast(event_id as varchar) as ref, ts as at from events union all select o_custkey, 'decision', cast(o_orderkey as varchar), o_orderdate from orders")
def edit_history(t):
    """SET06."""
    v = t("events").select(F.col("user_id").alias("cluster_key"), F.col("event_id").alias("version"), F.col("ts").alias("saved_at"))
    return curation.history(v, _decisions(t))


EFFECTS_SQL = """
with recursive steps as (select o_custkey as k, o_orderkey as id, o_totalprice as price, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as other, case when o_orderpriority like '1%' then o_orderstatus || o_custkey end as name from orders),
log as (select cast(round(price * 100) as bigint) * 10000000000 + id as moment, id as target, other as source, name from steps where other is not null),
walk as (select o_orderkey as id, o_orderkey as pos, 0::bigint as moment from orders
  union all select walk.id, arg_min(log.target, log.moment), min(log.moment) from walk join log on log.source = walk.pos and log.moment > walk.moment group by walk.id),
final as (select id, arg_max(pos, moment) as pos from walk group by id)
select o_orderkey as station_id, pos as final_id, coalesce(arg_max(l.target = o_orderkey, l.moment) , true) as is_active, arg_max(case when l.source = o_orderkey then l.target end, case when l.source = o_orderkey then l.moment end) as merged_into,
  coalesce(arg_max(case when l.target = o_orderkey then l.name end, case when l.target = o_orderkey and l.name is not null then l.moment end), o_orderstatus) as display_name
from orders join final on id = o_orderkey left join log l on l.target = o_orderkey or l.source = o_orderkey group by o_orderkey, pos, o_orderstatus
"""


@query(EFFECTS_SQL)
def decision_effects(t):
    """PIP11: each order takes in its customer's next one, in order of price, so some merges move what earlier ones brought."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    steps = t("orders").withColumn("other", F.lead("o_orderkey").over(w)).filter("other is not null")
    at = F.round(F.col("o_totalprice") * 100).cast("long") * 10_000_000_000 + F.col("o_orderkey")
    log = steps.select(at.alias("at"), F.inline(F.array(F.struct(F.lit(0).alias("pos"), F.col("o_orderkey").alias("station_id")), F.struct(F.lit(1).alias("pos"), F.col("other").alias("station_id")))), F.when(F.col("o_orderpriority").startswith("1"), F.concat("o_orderstatus", "o_custkey")).alias("rename_to"))
    stations = t("orders").select(F.col("o_orderkey").alias("station_id"), F.col("o_orderstatus").alias("display_name"), F.lit("").alias("country"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(True).alias("is_active"))
    log = storage.stored(decisions.members(log), "members")
    after = decisions.decided_stations(log, stations).select("station_id", "is_active", "merged_into", "display_name")
    ends = decisions.moved(stations.select("station_id", F.col("station_id").alias("ref"), "is_active"), decisions.redirects(log)).select(F.col("ref").alias("station_id"), F.col("station_id").alias("final_id"))
    return after.join(ends, "station_id")


STATE_SQL = """
with recursive e as (select user_id as k, event_id as id, props, case event_type when 'click' then case when value < 15 then 'reopen' else 'save' end when 'view' then 'undo' when 'purchase' then 'resolve' when 'signup' then 'reset' when 'error' then case when value > 50 then 'dismiss_clear' else 'dismiss' end else 'reopen' end as a,
  row_number() over (partition by user_id order by event_id) as i from events),
walk as (
  select distinct k, 0 as i, 0 as n, false as w, 'open' as s, null::bigint as last, null::bigint as prev, null::bigint as cur, 0 as version from e
  union all
  select walk.k, e.i,
    n + case when a = 'save' or (a = 'undo' and n >= 2) or (a in ('resolve', 'dismiss') and w) or (w and (a = 'reset' or (a = 'undo' and n = 1))) then 1 when a = 'dismiss_clear' and w then 2 else 0 end,
    case when a = 'save' or (a = 'undo' and n >= 2) then true when a in ('reset', 'dismiss_clear') or (a = 'undo' and n = 1) then false else w end,
    case when a = 'save' or (a = 'undo' and n >= 2) then case s when 'open' then 'in_review' else s end when a = 'reset' or (a = 'undo' and n = 1) then 'open' when a = 'reopen' and s in ('resolved', 'dismissed') then case when w then 'in_review' else 'open' end
      when a = 'resolve' and w then 'resolved' when a in ('dismiss', 'dismiss_clear') then 'dismissed' else s end,
    case when a = 'save' then id when a = 'undo' and n >= 2 then prev when a in ('resolve', 'dismiss') and w then cur when w and (a in ('reset', 'dismiss_clear') or (a = 'undo' and n = 1)) then null else last end,
    case when a = 'save' or (a = 'undo' and n >= 2) or (a in ('resolve', 'dismiss') and w) or (w and (a = 'reset' or (a = 'undo' and n = 1))) then last when a = 'dismiss_clear' and w then cur else prev end,
    case when a = 'save' then id when a = 'undo' and n >= 2 then prev when a in ('reset', 'dismiss_clear') or (a = 'undo' and n = 1) then null else cur end,
    case when a = 'save' or (a = 'undo' and n >= 2) or (a in ('resolve', 'dismiss') and w) then n + 1 else version end
  from walk join e on e.k = walk.k and e.i = walk.i + 1)
select walk.k as cluster_key, s as status, w as has_workspace, case when w then version else 0 end as version, n as versions, case when w then props end as payload from walk left join e on e.k = walk.k and e.id = cur qualify row_number() over (partition by walk.k order by walk.i desc) = 1
"""


@query(STATE_SQL)
def workspace_state(t):
    """PIP12, WIN15: events of users as what happens to workspaces."""
    kind = F.col("event_type")
    a = F.when(kind == "click", F.when(F.col("value") < 15, "reopen").otherwise("save")).when(kind == "view", "undo").when(kind == "purchase", "resolve").when(kind == "signup", "reset").when(kind == "error", F.when(F.col("value") > 50, "dismiss_clear").otherwise("dismiss")).otherwise("reopen")
    found = curation.workspace_state(t("events").select(F.col("user_id").alias("cluster_key"), F.col("event_id").alias("version"), a.alias("action"), F.col("props").alias("payload")))
    return found.withColumns({c: F.col(c).cast("long") for c in ("version", "versions")})


@query(
    f"""with {s.MAPPINGS}, st as (select distinct station_id, station_id % 9 <> 0 as is_active from mappings where station_id % 11 <> 0), m as (select * from mappings where is_active)
select 'active_stations' as metric, count(*) as value from st where is_active union all select 'stations_without_mapping', count(*) from st where is_active and station_id not in (select station_id from m) union all select 'mappings_without_station', count(*) from m where station_id not in (select station_id from st where is_active)
union all select 'doubled_mappings', count(*) from (select 1 from m group by source_id, ref having count(*) > 1) union all select 'open_clusters', count(*) from customer where c_custkey not in (select o_custkey from orders) union all select 'orphan_decisions', count(*) from orders where o_custkey not in (select c_custkey from customer)"""
)
def audit_counts(t):
    """PIP14, PIP16."""
    m = s.mappings(t)
    st_ = m.filter("station_id % 11 <> 0").select("station_id", (F.col("station_id") % 9 != 0).alias("is_active")).distinct()
    return curation.audit(st_, m, t("customer").select(F.col("c_custkey").alias("cluster_key")), _decisions(t))


@query("select l_orderkey as entity_id, string_agg(l_partkey || '', ',' order by r, l_partkey || '') as members, first(p_name order by r, l_partkey || '') as display_name from (select distinct l_orderkey, l_partkey, p_name, case when p_size % 10 > 0 then p_size % 10 else 1073741824 end as r from lineitem join part on p_partkey = l_partkey) group by 1 having count(*) >= 2")
def workspace_merge(t):
    """WSP01, WSP08, PIP13."""
    ranks = t("part").select(F.col("p_partkey").cast("string").alias("ref"), (F.col("p_size") % 10).alias("rank"), F.col("p_name").alias("name"))
    return curation.merged_selection(t("lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_partkey").cast("string").alias("ref")), ranks)


@query(f"with {s.POINTS} select a.place_ref // 6 as entity_id, a.point_id as from_id, b.point_id as to_id, case when a.point_id % 4 = 0 and b.point_id = a.point_id + 2 then 77 else cast(greatest(30, least(900, round_even({s.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 1.25, 0))) as int) end as seconds from points a join points b on a.place_ref // 6 = b.place_ref // 6 and a.point_id < b.point_id")
def workspace_matrix(t):
    """WSP02, WSP04, WSP05."""
    nodes = s.points(t).select(F.floor(F.col("place_ref") / 6).cast("long").alias("entity_id"), F.col("point_id").alias("node_id"), "lat", "lon")
    o = nodes.filter("node_id % 4 = 0").select("entity_id", (F.col("node_id") + 2).alias("a"), F.col("node_id").alias("b"), F.lit(77).alias("seconds"))
    return curation.override_transfer(curation.transfer_matrix(nodes), o)


@query(
    """select o_custkey % 20 as run, count(*) as items, round(avg((o_orderstatus = 'O')::double), 4) as verdict_exact_rate, round(avg((o_orderstatus = 'P')::double), 4) as false_merge_rate, quantile_disc(o_totalprice, 0.5) as p50, quantile_disc(o_totalprice, 0.95) as p95, cast(sum(o_orderkey) as bigint) as tokens from orders group by 1"""
)
def eval_metrics(t):
    """PIP19, AGG21."""
    i = t("orders").select((F.col("o_custkey") % 20).alias("run"), (F.col("o_orderstatus") == "O").alias("verdict_exact"), (F.col("o_orderstatus") == "P").alias("false_merge"), F.lit(False).alias("false_dismiss"), F.col("o_totalprice").alias("latency"), F.col("o_orderkey").alias("tokens"), F.lit(0.0).alias("cost"))
    return evaluation.run_metrics(i, "run").drop("false_dismiss_rate", "cost")


@query(
    """with a as (select distinct l_suppkey as c, l_partkey as x, 1000000000000 + l_linenumber as y from lineitem where l_returnflag = 'A'), b as (select distinct l_suppkey as c, l_partkey as x, 1000000000000 + l_linenumber as y from lineitem where l_returnflag = 'N')
select c as case_id, count(*) as pairs, round(avg(case when b.x is not null and a.x is not null and (a.x + a.y) % 2 = 0 then 1.0 else 0.0 end), 4) as agreement from a full join b using (c, x, y) group by 1"""
)
def eval_agreement(t):
    """PIP19."""
    rel = lambda flag: t("lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("case_id"), F.col("l_partkey").alias("b"), (F.lit(1_000_000_000_000) + F.col("l_linenumber")).alias("a")).distinct()
    truth = rel("A").withColumn("relation", F.when((F.col("a") + F.col("b")) % 2 == 0, "merge").otherwise("separate"))
    return evaluation.pairwise_agreement(truth, rel("N").withColumn("relation", F.lit("merge")))


@query("select l_returnflag, count(*) as total, count(*) filter (l_linestatus = 'F') as failed, round(avg(l_quantity), 3) as mean_seconds, round(list_sort(list(l_quantity))[greatest(0, cast(floor(count(*) * 0.95) as int) - 1) + 1], 3) as p95_seconds, round(100 * avg((l_linestatus = 'F')::double), 2) as failed_percent from lineitem where l_shipdate >= timestamp '2000-01-01' group by 1")
def kpi_window(t):
    """AGG20, SNK06."""
    j = t("lineitem").select("l_returnflag", F.when(F.col("l_linestatus") == "F", "failed").otherwise("ok").alias("status"), F.col("l_shipdate").cast("timestamp").alias("started_at"), F.expr("cast(l_shipdate as timestamp) + make_dt_interval(0, 0, 0, l_quantity)").alias("ended_at"))
    return evaluation.kpis(j, F.lit("2000-01-01").cast("timestamp"), ["l_returnflag"])


@query()
def fn_sequence_ratio(t):
    """FN07: no SQL; held against difflib in tests."""
    from ..functions.text import sequence_ratio

    a, b = t("part").select((F.col("p_partkey") + 1).alias("k"), F.col("p_name").alias("a")), t("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("b"))
    return a.join(b, "k").select("k", F.round(sequence_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))
