"""Effects of merge and rename decisions on stations, mappings and stop points (PIP11).

log: ``at`` (order of the decisions, one number a merged group), pos (0 is the group's first member, which stays), station_id, rename_to (of the group;
a rename decision is a group of one). A group with one distinct member merges nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .. import storage


def members(log: DataFrame) -> DataFrame:
    """at, station_id, pos, rename_to, target, members: each member once, where it stands first. The functions below take it for the log; who calls several of them stores it once."""
    if "members" in log.columns:
        return log
    first = log.repartition("at").groupBy("at", "station_id").agg(F.min("pos").alias("pos"), F.max("rename_to").alias("rename_to"))  # one deal for both
    w = Window.partitionBy("at")
    return first.withColumn("target", F.min_by("station_id", "pos").over(w)).withColumn("members", F.count("*").over(w))


def _next(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """asked (station_id, at, ...) and ``next_at``: the first fact (station_id, at) of the station after it."""
    kept = [c for c in asked.columns if c not in ("station_id", "at")]
    kind = asked.select(F.struct(*kept)).schema[0].dataType
    both = asked.select("station_id", "at", F.struct(*kept).alias("_row"), F.lit(None).cast("long").alias("_fact")).unionByName(facts.select("station_id", "at", F.lit(None).cast(kind).alias("_row"), F.col("at").alias("_fact")).distinct())
    w = Window.partitionBy("station_id").orderBy("at")
    found = F.first("_fact", True).over(w.rangeBetween(1, Window.unboundedFollowing))
    return both.withColumn("next_at", found).filter("_row is not null").select("station_id", "at", "next_at", "_row.*")


def redirects(log: DataFrame) -> DataFrame:
    """station_id, final_id: where the mappings and stop points of each merged station end (those that stay are left out).

    What stood at a source goes to the target, and from there with the target's first later merge into another one. Each step is a pointer
    from one source row to the next, so pointers are doubled: as many joins as the logarithm of the longest way, and no walk over the log.
    """
    spark = log.sparkSession
    m = members(log).filter("members > 1")
    sources = m.filter("station_id <> target").select("station_id", F.col("at").cast("long").alias("at"), "target")
    # the next way out of the target, after this merge
    led = _next(sources.select(F.col("target").alias("station_id"), "at", F.col("station_id").alias("source")), sources)
    with storage.tables(spark) as held:
        now = held.stored(led.select(F.col("source").alias("station_id"), "at", F.col("station_id").alias("to"), "next_at"), "redirects")
        starts = now.groupBy("station_id").agg(F.min("at").alias("at"))
        while now.filter("next_at is not null").limit(1).count():
            onward = now.select(F.col("station_id").alias("to"), F.col("at").alias("next_at"), F.col("to").alias("_to"), F.col("next_at").alias("_next"))
            joined = now.filter("next_at is not null").join(onward, ["to", "next_at"], "left")
            ended = now.filter("next_at is null")
            now = held.stored(ended.unionByName(joined.select("station_id", "at", F.coalesce("_to", "to").alias("to"), F.col("_next").alias("next_at"))), "redirects")
        return storage.stored(now.join(starts, ["station_id", "at"], "left_semi").select("station_id", F.col("to").alias("final_id")), "redirects")


def moved(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Mappings or stop points with the station that they end at; inactive ones stay where they are. found: redirects()."""
    joined = rows.join(found, "station_id", "left")
    to = F.when(F.coalesce("is_active", F.lit(False)), F.col("final_id"))
    return joined.withColumn("station_id", F.coalesce(to, "station_id")).select(*rows.columns)


def _told(log: DataFrame) -> DataFrame:
    """members() with what the log has told of the station: since (its last merge as a target, before this one), and up to this one made (the same), active, into, name; is_last for its last row."""
    c = F.col
    w = Window.partitionBy("station_id").orderBy("at")
    merged, stays = c("members") > 1, c("station_id") == c("target")
    last = lambda test, x, end=Window.currentRow: F.last(F.when(test, x), True).over(w.rowsBetween(Window.unboundedPreceding, end))
    made = c("at").cast("long")
    return members(log).select(
        "station_id", made.alias("at"), "pos", "target", "members", last(merged & stays, made, -1).alias("since"), last(merged & stays, made).alias("made"), last(merged, stays).alias("active"),
        last(merged & ~stays, c("target")).alias("into"), last(stays & F.nullif("rename_to", F.lit("")).isNotNull(), c("rename_to")).alias("name"), F.lead("at").over(w).isNull().alias("is_last"),
    )


def _merged_values(told: DataFrame, stations: DataFrame, held: storage.Tables) -> DataFrame:
    """station_id, at, country, lat, lon of each merge's target after it: the first country of the members in order and the mean of their coordinates, each as it is by then. told: _told().

    Merges whose members are all known are worked out together, so there are as many rounds as merges build on one another; a round looks at open merges and at what the one before it found.
    """
    values = ("country", "lat", "lon")
    plain = stations.select("station_id", *values)
    fresh = F.col("since").isNull()
    open_ = told.filter("members > 1").select("station_id", "at", "pos", "target", "since").join(plain, "station_id")
    open_ = open_.withColumns({"known": fresh, **{v: F.when(fresh, F.col(v)) for v in values}})
    done = plain.select("station_id", F.lit(None).cast("long").alias("at"), *values).limit(0)
    found = []
    while True:
        seen = held.stored(open_.withColumn("ready", F.bool_and("known").over(Window.partitionBy("at"))), "open-merges")
        there = F.col("lat").isNotNull() & F.col("lon").isNotNull()
        ready = seen.filter("ready").groupBy("at", "target").agg(F.min(F.when(F.nullif("country", F.lit("")).isNotNull(), F.struct("pos", "country")))["country"].alias("country"), *(F.avg(F.when(there, F.col(v))).alias(v) for v in ("lat", "lon")))
        new = held.stored(ready.select(F.col("target").alias("station_id"), "at", *values), "merged-values")
        found.append(new)
        if len(found) > 16:  # a long plan is not read again and again
            found = [held.stored(reduce(DataFrame.unionByName, found), "merged-values")]
        rest = seen.filter("not ready")
        if not rest.limit(1).count():
            return reduce(DataFrame.unionByName, found, done)
        by_then = new.select("station_id", F.col("at").alias("since"), F.lit(True).alias("_new"), *(F.col(v).alias(f"_{v}") for v in values))
        taken = F.col("_new").isNotNull()
        open_ = rest.join(by_then, ["station_id", "since"], "left").select("station_id", "at", "pos", "target", "since", (F.col("known") | taken).alias("known"), *(F.when(taken, F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values))


def decided_stations(log: DataFrame, stations: DataFrame) -> DataFrame:
    """stations (station_id, display_name, country, lat, lon, is_active) as they are after the log, and merged_into, the last target that a station went into.

    A source becomes inactive, a target active; which of the two came last counts. A name is the last that a decision gave the station. Decisions on unknown stations change nothing.
    """
    with storage.tables(stations.sparkSession) as held:
        told = held.stored(_told(log), "told")
        values = _merged_values(told, stations, held).select("station_id", F.col("at").alias("made"), F.struct("country", "lat", "lon").alias("_v"))
        last = told.filter("is_last").select("station_id", "made", F.col("active").alias("_active"), F.col("into").alias("merged_into"), F.col("name").alias("_name"))
        rows = stations.join(last, "station_id", "left").join(values, ["station_id", "made"], "left")
        over = lambda c: F.coalesce(F.col(f"_v.{c}"), F.col(c)).alias(c)
        return storage.stored(rows.select("station_id", F.coalesce("_name", "display_name").alias("display_name"), over("country"), over("lat"), over("lon"), F.coalesce("_active", "is_active").alias("is_active"), "merged_into"), "decided-stations")
