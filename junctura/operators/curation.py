"""Decisions and workspaces: latest state, history, publication, audits, editing (PIP11-PIP17, WSP)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import storage
from ..functions import geo
from .select import latest, top_per_group


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """WIN09."""
    return latest(decisions, ["cluster_key"], ["created_at", "decision_id"])


def published(clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """The latest decision of each cluster that still exists (PIP15)."""
    return latest_decisions(decisions).join(clusters.select("cluster_key"), "cluster_key", "left_semi")


#: What can happen to a workspace, and the states of its cluster.
ACTIONS = ("save", "undo", "reset", "reopen", "resolve", "dismiss", "dismiss_clear")
STATUSES = ("open", "in_review", "resolved", "dismissed")
#: Events of a cluster that are summarised at once.
LOG_BLOCK = 1024
#: Members of merges in a task's part.
MERGE_ROWS = 500_000


def _after(x: Column, e: Column) -> Column:
    """A workspace's state after an event. n: versions so far, 2 at most; w: whether there is a workspace; s: status; last, prev, cur: the events that made the last two versions and the workspace; total, curv: numbers of versions."""
    n, w, s, last, prev, cur, total = (x[k] for k in ("n", "w", "s", "last", "prev", "cur", "total"))
    is_ = lambda a: e["action"] == a
    back, kept = is_("undo") & (n >= 2), is_("resolve") | is_("dismiss")
    clears = w & (is_("reset") | (is_("undo") & (n == 1)))
    put = is_("save") | back | (kept & w)  # a version is made, and is the workspace
    value = F.when(is_("save"), e["id"]).when(back, prev).otherwise(cur)
    twice = is_("dismiss_clear") & w  # the workspace is kept once more, then an empty version follows
    opened = F.when(s == 0, 1).otherwise(s)
    status = F.when(is_("save") | back, opened).when(is_("reset") | (is_("undo") & (n == 1)), 0).when(is_("reopen") & (s >= 2), w.cast("int")).when(is_("resolve") & w, 2).when(is_("dismiss") | is_("dismiss_clear"), 3).otherwise(s)
    return F.struct(
        F.when(put | clears, F.least(n + 1, F.lit(2))).when(twice, 2).otherwise(n).alias("n"),
        F.when(put, True).when(clears | twice, False).otherwise(w).alias("w"),
        status.alias("s"),
        F.when(put, value).when(clears | twice, F.lit("$empty")).otherwise(last).alias("last"),
        F.when(put | clears, last).when(twice, cur).otherwise(prev).alias("prev"),
        F.when(put, value).when(clears | twice, F.lit("$none")).otherwise(cur).alias("cur"),
        (total + F.when(put | clears, 1).when(twice, 2).otherwise(0)).alias("total"),
        F.when(put, total + 1).otherwise(x["curv"]).alias("curv"),
    )


def _start(n, w, s, last: str, prev: str, cur: str) -> Column:
    as_ = lambda v, kind, name: (v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name)
    return F.struct(as_(n, "int", "n"), as_(w, "boolean", "w"), as_(s, "int", "s"), as_(last, "string", "last"), as_(prev, "string", "prev"), as_(cur, "string", "cur"), as_(0, "long", "total"), as_(None, "long", "curv"))


def _led(x: Column, table: Column) -> Column:
    """The state after a block of events: what the block makes of a state like this one, with this one's versions put in."""
    t = F.element_at(table, x["n"] * 8 + x["w"].cast("int") * 4 + x["s"] + 1)
    put = lambda c: F.when(c == "$last", x["last"]).when(c == "$prev", x["prev"]).when(c == "$cur", x["cur"]).otherwise(c)
    return F.struct(t["n"].alias("n"), t["w"].alias("w"), t["s"].alias("s"), put(t["last"]).alias("last"), put(t["prev"]).alias("prev"), put(t["cur"]).alias("cur"), (x["total"] + t["total"]).alias("total"), F.coalesce(x["total"] + t["curv"], x["curv"]).alias("curv"))


def workspace_state(events: DataFrame, block: int = LOG_BLOCK) -> DataFrame:
    """cluster_key, status, has_workspace, version, versions, payload after all events of each cluster (PIP12). events: cluster_key, version (their order), action, payload.

    An undo makes the version before the last a new version, so a second undo comes back; with one version it clears the workspace. A reset clears it and opens
    the cluster; resolving needs a workspace and keeps it as a version; reopening needs a resolved or dismissed cluster. What isn't allowed changes nothing.
    payload is null for a cleared workspace's empty version.

    What a block of events does is a small table, one row for each kind of state before it, so blocks are summarised apart and their tables composed.
    """
    w = Window.partitionBy("cluster_key").orderBy("version")
    placed = events.withColumn("block", F.floor((F.row_number().over(w) - 1) / block))
    log = placed.groupBy("cluster_key", "block").agg(F.array_sort(F.collect_list(F.struct("version", F.col("version").cast("string").alias("id"), "action"))).alias("log"))
    before = F.sequence(F.lit(0), F.lit(23))
    table = F.transform(before, lambda c: F.aggregate("log", _start(F.floor(c / 8), F.floor(c / 4) % 2 == 1, c % 4, "$last", "$prev", "$cur"), _after))
    tables = log.select("cluster_key", "block", table.alias("table")).groupBy("cluster_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "table"))), lambda x: x["table"]).alias("tables"))
    last = tables.select("cluster_key", F.aggregate("tables", _start(0, False, 0, "$empty", "$empty", "$none"), _led).alias("x"))
    status = F.element_at(F.array(*map(F.lit, STATUSES)), F.col("x.s") + 1)
    found = last.select("cluster_key", status.alias("status"), F.col("x.w").alias("has_workspace"), F.when(F.col("x.w"), F.col("x.curv")).otherwise(0).alias("version"), F.col("x.total").alias("versions"), F.when(F.col("x.w"), F.col("x.cur")).alias("_made"))
    made = events.select("cluster_key", F.col("version").cast("string").alias("_made"), "payload")
    return found.join(made, ["cluster_key", "_made"], "left").drop("_made")


def previous_version(events: DataFrame) -> DataFrame:
    """WIN15."""
    return top_per_group(events, ["cluster_key"], [F.desc("version")], 2)


def history(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edits and decisions, newest first in the time column (SET06)."""
    a = versions.select("cluster_key", F.lit("workspace").alias("kind"), F.col("version").cast("string").alias("ref"), F.col("saved_at").alias("at"))
    return a.unionByName(decisions.select("cluster_key", F.lit("decision").alias("kind"), F.col("decision_id").cast("string").alias("ref"), F.col("created_at").alias("at")))


def materialized(workspaces: DataFrame) -> DataFrame:
    """workspaces: cluster_key, kind (merge, group), entity_id, member. Members by entity; a merge inside a group belongs to the group (PIP13)."""
    inside = workspaces.filter("kind = 'group'").select("cluster_key", F.col("member").alias("entity_id"))
    merges = workspaces.filter("kind = 'merge'").join(inside, ["cluster_key", "entity_id"], "left_anti")
    return merges.unionByName(workspaces.filter("kind = 'group'")).groupBy("cluster_key", "kind", "entity_id").agg(F.array_sort(F.collect_set("member")).alias("members")).filter("size(members) >= 2")


def merged_selection(selected: DataFrame, ranks: DataFrame) -> DataFrame:
    """selected: entity_id, ref. The new merge's members in rank order and its name, of the best rank (WSP01, WSP08). ranks: ref, rank, name."""
    place = F.coalesce(F.when(F.col("rank") > 0, F.col("rank")), F.lit(1 << 30))
    joined = selected.join(ranks, "ref", "left").groupBy("entity_id").agg(F.array_sort(F.collect_set(F.struct(place.alias("p"), F.col("ref"), F.col("name")))).alias("m")).filter("size(m) >= 2")
    return joined.select("entity_id", F.array_join(F.transform("m", lambda x: x["ref"]), ",").alias("members"), F.get("m", F.lit(0))["name"].alias("display_name"))


def transfer_matrix(nodes: DataFrame) -> DataFrame:
    """nodes: entity_id, node_id, lat, lon. Walking seconds of each unordered pair (WSP02, WSP05)."""
    a, b = (nodes.select("entity_id", F.col("node_id").alias(f"{p}_id"), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon")) for p in ("from", "to"))
    d = geo.haversine_m(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))
    return a.join(b, "entity_id").filter("from_id < to_id").select("entity_id", "from_id", "to_id", geo.walk_seconds(d).alias("seconds"))


def override_transfer(matrix: DataFrame, overrides: DataFrame) -> DataFrame:
    """overrides: entity_id, a, b, seconds, either direction (WSP04)."""
    o = overrides.select("entity_id", F.least("a", "b").alias("from_id"), F.greatest("a", "b").alias("to_id"), F.col("seconds").alias("_s"))
    return matrix.join(o, ["entity_id", "from_id", "to_id"], "left").withColumn("seconds", F.coalesce("_s", "seconds")).drop("_s")


def audit(stations: DataFrame, mappings: DataFrame, clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """Counts that must be zero, or that tell the queue's state (PIP14): metric, value."""
    active = mappings.filter("is_active")
    n = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    doubled = active.groupBy("source_id", "ref").count().filter("count > 1")
    rows = [
        n(stations.filter("is_active"), "active_stations"), n(stations.filter("is_active").join(active, "station_id", "left_anti"), "stations_without_mapping"), n(active.join(stations.filter("is_active"), "station_id", "left_anti"), "mappings_without_station"),
        n(doubled, "doubled_mappings"), n(clusters.join(decisions, "cluster_key", "left_anti"), "open_clusters"), n(decisions.join(clusters, "cluster_key", "left_anti"), "orphan_decisions"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def rail_items(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Entities first, then candidates that none has absorbed, by rank (WSP09). entities: cluster_key, entity_id, kind, member; candidates: cluster_key, id, rank."""
    absorbed = entities.select("cluster_key", F.col("member").alias("id"))
    heads = entities.select("cluster_key", F.col("entity_id").alias("item"), F.when(F.col("kind") == "merge", 0).otherwise(1).alias("section"), F.lit(0).alias("rank")).distinct()
    rest = candidates.join(absorbed, ["cluster_key", "id"], "left_anti").select("cluster_key", F.col("id").alias("item"), F.lit(2).alias("section"), F.col("rank").cast("int").alias("rank"))
    w = Window.partitionBy("cluster_key").orderBy("section", "rank", "item")
    return heads.unionByName(rest).withColumn("place", F.row_number().over(w))


def without_member(merges: DataFrame, removed: DataFrame) -> DataFrame:
    """merges: cluster_key, entity_id, member; removed: the same columns. Members that stay, of merges that keep two (WSP06)."""
    keys = ["cluster_key", "entity_id", "member"]
    named = F.col("cluster_key").isNotNull() & F.col("entity_id").isNotNull()
    rows = merges.filter(named).withColumn("_removal", F.lit(False)).unionByName(removed.filter(named).select(*keys, F.lit(True).alias("_removal")), allowMissingColumns=True)
    # an entity's rows are dealt and sorted once, for both questions
    parts = max(storage.shuffle_partitions(merges.sparkSession), merges.count() // MERGE_ROWS)
    dealt = rows.repartition(parts, "cluster_key", "entity_id")
    gone = F.max("_removal").over(Window.partitionBy(*keys)) & F.col("member").isNotNull()
    rest = dealt.withColumn("_gone", gone).filter(~F.col("_gone") & ~F.col("_removal"))
    w = Window.partitionBy("cluster_key", "entity_id")
    return rest.withColumn("_two", F.min("member").over(w) < F.max("member").over(w)).filter("_two").select(*merges.columns)


def edited_composites(composites: DataFrame, edits: DataFrame) -> DataFrame:
    """composites: cluster_key, kind, entity_id, display_name; edits: cluster_key, kind, entity_id, seq, action (split, rename), value. A split composite goes, a renamed one has its last name (WSP03)."""
    keys = ["cluster_key", "kind", "entity_id"]
    found = edits.groupBy(*keys).agg(F.max(F.col("action") == "split").alias("split"), F.max(F.when(F.col("action") == "rename", F.struct("seq", "value"))).alias("name"))
    joined = composites.join(found, keys, "left").filter(~F.coalesce("split", F.lit(False)))
    return joined.select(*keys, F.when(F.col("name").isNotNull(), F.col("name.value")).otherwise(F.col("display_name")).alias("display_name"))


def kept_apart(selected: DataFrame) -> DataFrame:
    """selected: cluster_key, set_id, ref. Sets of two distinct refs at least, sorted (WSP07)."""
    return selected.groupBy("cluster_key", "set_id").agg(F.array_sort(F.collect_set("ref")).alias("refs")).filter("size(refs) >= 2")


def summary_counts(df: DataFrame, by: str, of: str) -> DataFrame:
    """Values of a column per group with their counts and places, most first, ties by value; nulls have no count (WSP10)."""
    counts = df.filter(F.col(of).isNotNull()).groupBy(by, of).agg(F.count("*").alias("count"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("count"), of)))


#: Kinds of evidence whose values are shown as per cent or as counts, as fixed values.
PERCENT_KINDS = ("name_loose_similarity", "token_overlap")
COUNT_KINDS = ("shared_provider_sources", "shared_route_context", "shared_adjacent_stations", "coordinate_quality", "generic_name_penalty", "external_reference_coverage")
STATUS_LABELS = {
    "supporting": "Supporting", "warning": "Warning", "missing": "Missing", "informational": "Context", "same_location": "Same Loc", "nearby": "Nearby",
    "far_apart": "Far", "too_far": "Too Far", "missing_coordinates": "No Coords", "coordinates_present": "Coords",
}
METRE_KINDS = ("external_reference_nearby_alignment", "external_reference_conflict")


def status_label(status: Column) -> Column:
    """A status as shown: its label, else its words, else Unknown."""
    labels = F.create_map(*(F.lit(x) for kv in STATUS_LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(labels, status), F.initcap(F.replace(F.coalesce(F.nullif(status, F.lit("")), F.lit("unknown")), F.lit("_"), F.lit(" "))))


def evidence_value(kind: Column, raw: Column, score: Column, same_country: Column, distance_status: Column) -> Column:
    """How a row of evidence is shown: metres, per cent, count, Same, Cross or ? (WSP11). raw: double."""
    whole = lambda x: F.floor(x + 0.5).cast("string")  # noqa: E731  halves go up
    there = raw.isNotNull() & ~F.isnan(raw)
    count = F.when(raw == F.floor(raw), raw.cast("long").cast("string")).otherwise(raw.cast("string"))
    return (
        F.when(kind == "geographic_distance", F.when(there, F.concat(whole(raw), F.lit("m"))).otherwise(status_label(distance_status)))
        .when(kind.isin(*METRE_KINDS) & there & (raw > 1), F.concat(whole(raw), F.lit("m")))
        .when(kind.isin(*PERCENT_KINDS) & there, F.concat(whole(raw * 100), F.lit("%")))
        .when(kind.isin(*COUNT_KINDS) & there, count)
        .when(kind == "country_relation", F.when(same_country, "Same").when(~same_country, "Cross").otherwise("?"))
        .when(score.isNotNull() & ~F.isnan(score), F.concat(whole(score * 100), F.lit("%")))
        .otherwise("\u2014")
    )


def composite_places(members: DataFrame) -> DataFrame:
    """members: entity_id, lat, lon. Mean place of the members that have one, else null (FN43), and its key of seven decimals (FN44)."""
    there = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    mean = members.groupBy("entity_id").agg(F.avg(F.when(there, F.col("lat"))).alias("lat"), F.avg(F.when(there, F.col("lon"))).alias("lon"))
    return mean.withColumn("bucket", F.concat_ws(",", F.format_string("%.7f", "lat"), F.format_string("%.7f", "lon")))


def coverage(pairs: DataFrame) -> DataFrame:
    """pairs: a, b, left, right (arrays of sources, null: none). Shared sources and those of one side, sorted, and their score; pairs without sources have no row (AGG18)."""
    none = F.array().cast("array<string>")
    left, right = (F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, none)))) for c in ("left", "right"))
    p = pairs.select("a", "b", left.alias("l"), right.alias("r")).filter("size(l) + size(r) > 0")
    shared = F.array_intersect("l", "r")
    return p.select("a", "b", shared.alias("shared"), F.array_except("l", "r").alias("left_only"), F.array_except("r", "l").alias("right_only"), (F.size(shared) / F.size(F.array_union("l", "r"))).alias("score"))


def source_labels(sources: DataFrame) -> DataFrame:
    """id, label of sources: provider and dataset, whichever is there, else the id (PIP22). sources: id, provider, dataset."""
    text = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return sources.select("id", F.coalesce(F.nullif(F.concat_ws(" - ", text("provider"), text("dataset")), F.lit("")), F.trim("id")).alias("label"))


def labelled(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """ids: key, id. Distinct labels per key, sorted; an id that the catalogue lacks stands for itself, blank ones drop out."""
    known = ids.withColumn("id", F.trim("id")).filter("id <> ''").join(labels, "id", "left")
    return known.groupBy("key").agg(F.array_sort(F.collect_set(F.coalesce("label", "id"))).alias("labels"))


def best_reference(refs: DataFrame, by: list[str]) -> DataFrame:
    """The reference of each group: primary first, then confidence (missing last), then the smallest (SRT11). refs: ..., ref, is_primary, confidence."""
    return top_per_group(refs, by, [F.desc("is_primary"), F.desc_nulls_last("confidence"), F.col("ref")])


def approximate_places(items: DataFrame) -> DataFrame:
    """items with lat, lon and ``approx``: one without coordinates gets the mean of its two nearest located items of the same name by rank (FN42).

    items: cluster_key, ref, display_name, rank, lat, lon. Names are equal without case and outer blanks; a rank of 0 or null is 9999. Of equally near ranks the
    lower comes first, then the smaller ref. Only two items of a rank can count, so each rank keeps two, and an item looks at its own rank and the two before and after.
    """
    name, place = F.lower(F.trim(F.coalesce("display_name", F.lit("")))), F.coalesce(F.nullif("rank", F.lit(0)), F.lit(9999)).cast("long")
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    rows = items.withColumns({"_name": name, "_rank": place, "approx": F.lit(False)})
    by, near = ["cluster_key", "_name"], Window.partitionBy("cluster_key", "_name", "_rank").orderBy("ref")
    two = rows.filter(located).withColumn("_k", F.row_number().over(near)).filter("_k <= 2").groupBy(*by, "_rank").agg(F.array_sort(F.collect_list(F.struct("_rank", "ref", "lat", "lon"))).alias("two"))
    w = Window.partitionBy(*by).orderBy("_rank")
    none = F.array().cast(two.schema["two"].dataType)
    spots = two.withColumns({"back": F.concat(F.coalesce(F.lag("two").over(w), none), "two"), "on": F.concat("two", F.coalesce(F.lead("two").over(w), none))})
    asked = rows.filter(~F.coalesce(located, F.lit(False)))
    kind = asked.select(F.struct(*asked.columns)).schema[0].dataType
    both = spots.select(*by, "_rank", "two", "back", "on", F.lit(None).cast(kind).alias("_row")).unionByName(asked.select(*by, "_rank", *(F.lit(None).cast(spots.schema[c].dataType).alias(c) for c in ("two", "back", "on")), F.struct(*asked.columns).alias("_row")))
    seen = both.withColumns({
        "_before": F.last("back", True).over(w.rangeBetween(Window.unboundedPreceding, -1)), "_here": F.first("two", True).over(w.rangeBetween(0, 0)), "_after": F.first("on", True).over(w.rangeBetween(1, Window.unboundedFollowing)),
    }).filter("_row is not null")
    all_ = F.concat(*(F.coalesce(c, none) for c in ("_here", "_before", "_after")))
    peers = F.slice(F.array_sort(F.transform(all_, lambda p: F.struct(F.abs(p["_rank"] - F.col("_rank")).alias("d"), p["_rank"].alias("r"), p["ref"].alias("ref"), p["lat"].alias("lat"), p["lon"].alias("lon")))), 1, 2)
    mean = lambda c: F.aggregate("_peers", F.lit(0.0), lambda t, p: t + p[c]) / F.size("_peers")
    placed = seen.withColumn("_peers", peers).select("_row.*", "_peers").withColumn("approx", F.size("_peers") > 0).withColumns({c: F.when(F.col("approx"), mean(c)).otherwise(F.col(c)) for c in ("lat", "lon")})
    return rows.filter(located).select(*items.columns, "approx").unionByName(placed.select(*items.columns, "approx"))
