"""Feeds cut to a box or a tier, and test queries from them (PIP07, PIP08, FN26, FN27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo, rules
from .graph import closure
from .select import endpoints, first_distinct


def stops_in_box(stops: DataFrame, box: tuple[float, float, float, float], km: float = 20.0) -> DataFrame:
    """stop_id of the stops in a padded box, with their parents and children (FIL06, GRF02). stops: stop_id, parent_station, lat, lon."""
    inside = stops.filter(geo.in_box(F.col("stop_lat"), F.col("stop_lon"), *geo.padded_box(*box, km)))
    tree = stops.filter("parent_station is not null").select(F.col("stop_id").alias("child"), F.col("parent_station").alias("parent"))
    return closure(inside.select(F.col("stop_id").alias("id")), tree).withColumnRenamed("id", "stop_id")


def trips_in(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Trips with two stops in the scope at least."""
    return stop_times.join(stops.select("stop_id"), "stop_id", "left_semi").groupBy("trip_id").agg(F.count("*").alias("n")).filter("n >= 2").select("trip_id")


def tier_routes(routes: DataFrame, tiers: list[str]) -> DataFrame:
    tier = rules.route_tier(F.col("route_desc"), F.col("route_type"), F.col("route_short_name"), F.col("route_long_name"))
    return routes.withColumn("tier", tier).filter(F.col("tier").isin(*tiers))


def _active(calendar: DataFrame, exceptions: DataFrame, days: Column, by: list[str]) -> DataFrame:
    """by, service_id, day: services that run on one of an array of days: weekday and range, then the last exception of the day."""
    names = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
    runs = F.element_at(F.array(*(F.col(n) == 1 for n in names)), F.dayofweek("day"))
    keys = [*by, "service_id", "day"]
    base = calendar.withColumn("day", F.explode(days)).filter(F.col("day").between(F.col("start_date"), F.col("end_date")) & runs).select(*keys)
    last = exceptions.withColumn("day", F.col("date")).filter(F.array_contains(days, F.col("day"))).groupBy(*keys).agg(F.max_by("type", "seq").alias("type"))
    return base.join(last.filter("type = 2"), keys, "left_anti").union(last.filter("type = 1").select(*keys)).distinct()


def active_services(calendar: DataFrame, exceptions: DataFrame, day: Column) -> DataFrame:
    """Services that run on a day (FN26). exceptions: service_id, date, type (1: runs, 2: does not), seq."""
    return _active(calendar, exceptions, F.array(day), []).select("service_id")


def active_date(calendar: DataFrame, exceptions: DataFrame, today: Column, ahead: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """The first day from today on with a service that runs, else the earliest start (FN27); one row, or one for each feed (columns ``by``)."""
    found = _active(calendar, exceptions, F.sequence(today, F.date_add(today, ahead)), list(by)).select(*by, "day", F.lit(None).cast("date").alias("start"))
    starts = calendar.select(*by, F.lit(None).cast("date").alias("day"), F.col("start_date").alias("start"))
    return found.unionByName(starts).groupBy(*by).agg(F.coalesce(F.min("day"), F.min("start")).alias("day"))


def test_queries(stop_times: DataFrame, n: int = 6) -> DataFrame:
    """First and last stop of trips, distinct, in order of the first trip that has them (SRT10). stop_times: trip_id, stop_sequence, stop_id."""
    ends = endpoints(stop_times, "trip_id", "stop_sequence", "stop_id").filter("first <> last")
    return first_distinct(ends.select("trip_id", "first", "last"), ["first", "last"], [F.col("trip_id")], n)
