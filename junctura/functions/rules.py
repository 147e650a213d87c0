"""Classifications and scores: trips, routes, services, matches, evidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Word parts of trip texts by tier, in the order they are tried; fixed values.
TRIP_TIERS = {
    "high-speed": ("high_speed", "high-speed", "ice", "tgv", "railjet", "freccia"),
    "local": ("tram", "metro", "subway", "bus", "u-bahn", "s-bahn", "local"),
}
#: GTFS route types by tier and words of high-speed services; fixed values.
HIGH_SPEED_TYPES, LOCAL_TYPES = ("101", "102"), ("0", "1", "5", "6", "7", "11", "12", "700", "900")
HIGH_SPEED_WORDS = ("ICE", "TGV", "RJX", "RJ", "FRECCIAROSSA", "FRECCIA", "EUROSTAR", "THALYS", "AVE", "AVLO", "RAILJET")
#: Categories of evidence and of seed reasons; fixed values.
EVIDENCE_CATEGORY = {
    "name_exact": "core_match",
    "name_loose_similarity": "core_match",
    "token_overlap": "core_match",
    "geographic_distance": "core_match",
    "shared_provider_sources": "network_context",
    "shared_route_context": "network_context",
    "shared_adjacent_stations": "network_context",
    "country_relation": "network_context",
    "coordinate_quality": "risk_conflict",
    "generic_name_penalty": "risk_conflict",
    "external_reference_same_entity": "core_match",
    "external_reference_nearby_alignment": "core_match",
    "external_reference_coverage": "network_context",
    "external_reference_conflict": "risk_conflict",
}
SEED_EVIDENCE = {
    "exact_name": "name_exact",
    "loose_name_geo": "name_loose_similarity",
    "loose_name_missing_coords": "name_loose_similarity",
    "shared_route": "shared_route_context",
    "shared_adjacent": "shared_adjacent_stations",
}


def _any(text: Column, parts) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def trip_tier(*texts: Column) -> Column:
    """Tier by parts of words in mode, names and headsign (FN21)."""
    t = F.lower(F.concat_ws(" ", *(F.coalesce(x, F.lit("")) for x in texts)))
    return F.when(_any(t, TRIP_TIERS["high-speed"]), "high-speed").when(_any(t, TRIP_TIERS["local"]), "local").otherwise("regional")


def route_tier(desc: Column, route_type: Column, short: Column, long: Column) -> Column:
    """Tier of a feed's route: a tag in its description, its type, whole words of its names (FN22)."""
    tag = F.regexp_extract(F.coalesce(desc, F.lit("")), r"tier:(high-speed|regional|local)\b", 1)
    names = F.concat_ws(" ", short, long, desc)
    return F.when(tag != "", tag).when(F.trim(route_type).isin(*HIGH_SPEED_TYPES), "high-speed").when(F.trim(route_type).isin(*LOCAL_TYPES), "local").when(names.rlike(rf"(?i)\b({'|'.join(HIGH_SPEED_WORDS)})\b"), "high-speed").otherwise("regional")


def route_type(mode: Column) -> Column:
    """GTFS route type of a mode (FN23)."""
    m = F.coalesce(mode, F.lit(""))
    return F.when(_any(m, ("metro", "subway", "u-bahn")), "1").when(m.contains("tram"), "0").when(m.contains("bus"), "3").otherwise("2")


def fallback_time(seq: Column) -> Column:
    """06:00 and five minutes per stop, within one day."""
    s = (F.lit(6 * 3600) + (seq - 1) * 300) % 86400
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int"))


def time_or_fallback(text: Column, seq: Column) -> Column:
    """A time of the form HH:MM:SS as it is, else the fallback (FN24)."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"^\d{2}:\d{2}:\d{2}$"), text).otherwise(fallback_time(seq))


def service_instant(date: Column, text: Column) -> Column:
    """Date and a time of 24 hours or more as ISO text (FN25)."""
    h, m, s = (F.get(F.split(text, ":"), F.lit(k)).cast("int") for k in range(3))
    at = date.cast("timestamp") + F.make_dt_interval(F.lit(0), h, m, s.cast("decimal(18,6)"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_iso_date(text: Column) -> Column:
    """A real date of the form YYYY-MM-DD (FN29)."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_country_code(text: Column) -> Column:
    return F.coalesce(text.rlike("^[A-Z]{2}$"), F.lit(False))


#: Time zones by country where they have a name of their own here; fixed values.
ZONES = {"AT": "Europe/Vienna", "CH": "Europe/Zurich"}


def country_zone(country: Column, default: str = "Europe/Berlin") -> Column:
    """FN28."""
    out = F.lit(default)
    for c, zone in ZONES.items():
        out = F.when(country == c, zone).otherwise(out)
    return out


#: Categories of places where transport stops; fixed values.
STATION_CATEGORIES = "station train_station rail_station railway transportation transport_hub transit transit_stop stop bus_station tram_stop metro_station subway_station".split()


def category_compatibility(category: Column) -> Column:
    """FN16: 1.0 for places where transport stops, else 0.7; a blank category counts as a station."""
    return F.when(F.coalesce(F.nullif(category, F.lit("")), F.lit("station")).isin(*STATION_CATEGORIES), 1.0).otherwise(0.7)


def match_confidence(similarity: Column, overlap: Column, distance: Column, equal: Column, category: Column) -> Column:
    """FN17."""
    bonus = F.when(distance.isNull() & equal, 0.20).when(distance.isNull(), 0.08).when(distance <= 50, 0.20).when(distance <= 250, 0.18).when(distance <= 500, 0.14).when(distance <= 1000, 0.09).when(distance <= 1500, 0.04).otherwise(0.0)
    return F.round(F.least(F.greatest(similarity, F.lit(0.0)), F.lit(1.0)) * 0.55 + F.least(overlap / 4.0, F.lit(1.0)) * 0.15 + bonus + category * 0.10, 4)


def match_status(similarity: Column, overlap: Column, distance: Column, equal: Column) -> Column:
    """FN18; a missing distance counts as near for very similar names."""
    there, some = distance.isNotNull(), overlap >= 1
    strong = (equal & there & (distance <= 250)) | ((similarity >= 0.97) & (F.coalesce(distance, F.lit(0.0)) <= 100))
    probable = ((similarity >= 0.87) & there & (distance <= 500)) | (~there & (equal | (similarity >= 0.92)) & some)
    weak = (some & there & (distance <= 1000)) | (~there & (similarity >= 0.80) & some)
    return F.when(strong, "strong").when(probable, "probable").when(weak, "weak")


def evidence_category(kind: Column) -> Column:
    """FN36."""
    pairs = [F.lit(x) for kv in EVIDENCE_CATEGORY.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit("core_match"))


def seed_evidence(reason: Column) -> Column:
    pairs = [F.lit(x) for kv in SEED_EVIDENCE.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), reason)
