"""Stations by what a user types: index, search, resolution of inputs (FN30-FN34, FIL14, PIP21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text


def _trimmed(c) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _number(c: Column) -> Column:
    """Digits without useless zeros."""
    out = F.regexp_replace(F.regexp_replace(c, r"^(-?)0+(?=[0-9])", "$1"), r"(\.[0-9]*?)0+$", "$1")
    out = F.regexp_replace(out, r"\.$", "")
    return F.when(out == "-0", "0").otherwise(out)


def coordinates(c: Column) -> Column:
    """``lat,lon`` of a text of that form and within the globe's bounds, else null (FN34)."""
    part = lambda k: F.regexp_extract(F.trim(c), r"^(-?[0-9]+(?:\.[0-9]+)?)\s*,\s*(-?[0-9]+(?:\.[0-9]+)?)$", k)
    ok = (F.abs(part(1).try_cast("double")) <= 90) & (F.abs(part(2).try_cast("double")) <= 180)
    return F.when(ok, F.concat(_number(part(1)), F.lit(","), _number(part(2))))


def bracket_id(c: Column) -> Column:
    """What the last brackets of a text hold, if it ends with them; blank counts as none (FN34)."""
    return F.nullif(F.trim(F.regexp_extract(F.trim(c), r"(?s)\[([^\[]*)\]$", 1)), F.lit(""))


def tagged(tag: str, stop_id: Column) -> Column:
    return F.when(stop_id.startswith(f"{tag}_") | F.lit(not tag), stop_id).otherwise(F.concat(F.lit(f"{tag}_"), stop_id))


def country_code(c: Column) -> Column:
    """Upper-case code of two letters, empty for a blank, null for what is no code (FN30)."""
    code = F.upper(_trimmed(c))
    return F.when((code == "") | code.rlike("^[A-Z]{2}$"), code)


def index(stops: DataFrame, tag: str) -> DataFrame:
    """Stations of stops, one for each text ``name [id]``, the first by seq; entrances, nodes and boarding areas are left out (PIP21).

    stops: seq, stop_id, stop_name, location_type, stop_lat, stop_lon. Rows without id or name drop out. Rank as the preferred pick needs it (FN32).
    """
    s = stops.select("seq", _trimmed("stop_id").alias("station_id"), _trimmed("stop_name").alias("name"), _trimmed("location_type").alias("location_type"), coordinates(F.concat_ws(",", _trimmed("stop_lat"), _trimmed("stop_lon"))).alias("coordinates"))
    kept = s.filter("name <> '' and station_id <> '' and location_type not in ('2', '3', '4')").withColumns({"value": F.concat("name", F.lit(" ["), "station_id", F.lit("]")), "token": tagged(tag, F.col("station_id"))})
    rest = [c for c in kept.columns if c != "value"]
    first = kept.groupBy("value").agg(F.min_by(F.struct(*rest), F.struct("seq", "station_id", "location_type")).alias("s")).select("value", "s.*")
    rank = F.when(F.col("location_type") == "1", 100).when(F.col("location_type").isin("", "0"), 20).otherwise(0) + 10
    return first.withColumns({"rank": rank, "name_fold": text.fold(F.col("name")), "value_fold": text.fold(F.col("value"))})


def preferred(stations: DataFrame, key: str) -> DataFrame:
    """The station of each key: highest rank, then smallest id in byte order, then first (FN32)."""
    rest = [c for c in stations.columns if c != key]
    best = stations.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(-F.col("rank"), "station_id", "seq")).alias("s"))
    return best.select(key, "s.*").select(*stations.columns)


def search(stations: DataFrame, query: str) -> DataFrame:
    """Stations whose folded name or value contains the folded query, or whose id contains it as it is; an empty one finds all (FIL14)."""
    q = text.fold(F.lit(query.strip()))
    return stations.filter((q == "") | F.contains("name_fold", q) | F.contains("value_fold", q) | F.contains("station_id", F.lit(query.strip())))


def resolved(inputs: DataFrame, stations: DataFrame, tag: str) -> DataFrame:
    """inputs: key, input. Adds resolved, strategy and matched (station id), by the first that applies (FN31).

    Empty, coordinates, an id with the tag; a station by id (in brackets or the whole input), by value, by name; an id in brackets; digits; the input itself.
    Each distinct input is looked up once; those without an id, which meet in one part, are few then.
    """
    asked = inputs.select("key", _trimmed("input").alias("input"))
    i = asked.select("input").distinct().withColumns({"_bracket": bracket_id(F.col("input")), "_fold": text.fold(F.col("input"))})
    i = i.withColumn("_id", F.coalesce("_bracket", F.when(F.col("input").rlike(r"^\S+$"), F.col("input"))))

    def by(key: str, name: str) -> DataFrame:
        return preferred(stations, key).select(F.col(key).alias(name), F.struct(F.col("station_id").alias("id"), "token").alias(f"{name}_s"))

    found = i.join(by("station_id", "_id"), "_id", "left").join(by("value_fold", "_fold").withColumnRenamed("_fold_s", "_value_s"), "_fold", "left").join(by("name_fold", "_fold"), "_fold", "left")
    s, text_of = F.coalesce("_id_s", "_value_s", "_fold_s"), F.col("input")
    plain = [(text_of == "", "empty", text_of), (coordinates(text_of).isNotNull(), "coordinates", coordinates(text_of)), (text_of.startswith(f"{tag}_"), "tagged_stop_id", text_of)]
    looked = [(s.isNotNull(), "station_lookup", s["token"]), (F.col("_bracket").isNotNull(), "bracket_id", tagged(tag, F.col("_bracket"))), (text_of.rlike("^[0-9]+$"), "numeric_stop_id", tagged(tag, text_of))]
    strategy, value = F.lit("raw"), text_of
    for test, name, v in reversed(plain + looked):
        strategy, value = F.when(test, name).otherwise(strategy), F.when(test, v).otherwise(value)
    match = F.when(strategy == "station_lookup", s["id"])
    told = found.select("input", value.alias("resolved"), strategy.alias("strategy"), match.alias("matched"))
    return asked.join(told, "input").select("key", "input", "resolved", "strategy", "matched")
