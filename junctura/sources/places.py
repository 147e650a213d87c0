"""Places of open map data: read by category and country, laid out along a curve, read by box, shown over stations (SRC16-SRC18, FIL07)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geo
from ..functions.text import normalize_name

#: Categories of places where people board, as fixed values: of the detailed and of the basic scheme.
PRIMARY = ("airport", "airport_terminal", "bus_station", "ferry_service", "light_rail_and_subway_stations", "metro_station", "public_transportation", "subway_station", "train_station", "transport_interchange", "tram_stop")
BASIC = ("airport", "airport_terminal", "bus_station", "train_station", "transport_interchange")
#: Web-mercator units by which the extent of stations grows before places are looked for.
MARGIN = 500.0
#: Cells along one side of the curve.
CELLS = 1 << 16
ROWS_PER_FILE = 1_000_000
JSON_FIELDS = "id string, external_id string, name string, display_name string, primary_name string, category string, subtype string, primary_category string, secondary_category string, basic_category string, country string, latitude double, longitude double, source_url string, metadata string"

Box = tuple[float, float, float, float]


def is_transit(category: Column, subtype: Column, basic: Column) -> Column:
    return category.isin(*PRIMARY) | subtype.isin(*PRIMARY) | basic.isin(*BASIC)


def nested_places(df: DataFrame, country: str | None = None) -> DataFrame:
    """Boarding places of a nested Parquet table, and of one country if that is given (SRC16). Null ids and places without any category drop out, null names are the id."""
    lower = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    own = F.lower(F.coalesce("basic_category", "categories.primary", F.lit("")))
    kept = df.filter(F.col("id").isNotNull() & is_transit(own, lower("categories.primary"), lower("basic_category")))
    if country:
        kept = kept.filter(F.coalesce(F.exists("addresses", lambda a: F.upper(a["country"]) == country.strip().upper()), F.lit(False)))
    name = F.coalesce("names.primary", F.col("id").cast("string"))
    return kept.select(
        F.col("id").cast("string").alias("external_id"), name.alias("display_name"), normalize_name(name).alias("normalized_name"), F.lit((country or "").strip().upper()).alias("country"),
        ((F.col("bbox.ymin") + F.col("bbox.ymax")) / 2).alias("latitude"), ((F.col("bbox.xmin") + F.col("bbox.xmax")) / 2).alias("longitude"), own.alias("category"), lower("categories.primary").alias("subtype"),
    )


def json_places(spark: SparkSession, path: str, country: str | None = None, array: bool = False) -> DataFrame:
    """Boarding places of JSON lines, or of files that are one array each (SRC17). A line that is no JSON fails the read.

    The first name of a field that is not empty counts. Rows of another country, without a name or without an id drop out; rows of no country take the one asked for. ``metadata`` is the text of the object as it stands.
    """
    strip = lambda c: F.btrim(c, F.lit(" \t\n\r\f\x0b"))
    first = lambda *cs: strip(F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in cs), F.lit("")))
    asked = (country or "").strip().upper()
    rows = spark.read.json(path, schema=JSON_FIELDS, multiLine=array, mode="FAILFAST")
    category, subtype, basic = first("category"), first("subtype", "primary_category", "secondary_category"), first("basic_category", "category")
    there, name = F.upper(strip(F.coalesce(F.when(F.col("country") != "", F.col("country")), F.lit(asked)))), first("display_name", "name", "primary_name")
    ident = first("external_id", "id")
    wanted = is_transit(F.lower(category), F.lower(subtype), F.lower(basic)) & (name != "") & (ident != "")
    if asked:
        wanted = wanted & there.isin("", asked)
    return rows.filter(wanted).select(
        ident.alias("external_id"), name.alias("display_name"), normalize_name(name).alias("normalized_name"), there.alias("country"), "latitude", "longitude",
        F.when(category != "", category).otherwise(basic).alias("category"), subtype.alias("subtype"), first("source_url").alias("source_url"), F.when(F.col("metadata").startswith("{"), F.col("metadata")).otherwise("{}").alias("metadata"),
    )


def _spread(n: Column) -> Column:
    """The 16 lowest bits of a number, each followed by a free one."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return n


def curve(lat: Column, lon: Column) -> Column:
    """Place of a coordinate along a curve through all cells in which near ones mostly stay near; null without a valid one."""
    cell = lambda c, low, width: F.least(F.floor((c - low) / width * CELLS), F.lit(CELLS - 1)).cast("long")
    return F.when(geo.valid(lat, lon), _spread(cell(lon, -180, 360.0)).bitwiseOR(F.shiftleft(_spread(cell(lat, -90, 180.0)), 1)))


def write_laid_out(places: DataFrame, path: str, extents: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write places (external_id, latitude, longitude, other columns) in files along the curve, then the extent of each file to a table of its own.

    Range parts are cut by curve and id, so a spot with very many places is spread over files. Places without a valid
    coordinate stand in the first files, whose extents do not count them.
    """
    files = max(1, math.ceil(places.count() / rows_per_file))
    order = (curve(F.col("latitude"), F.col("longitude")).asc_nulls_first(), F.col("external_id").asc_nulls_first())
    places.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(path)
    spark = places.sparkSession
    located = geo.valid(F.col("latitude"), F.col("longitude"))
    ends = [f(F.when(located, F.col(c))).alias(n) for n, f, c in (("west", F.min, "longitude"), ("south", F.min, "latitude"), ("east", F.max, "longitude"), ("north", F.max, "latitude"))]
    spark.read.schema(places.schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), *ends).write.parquet(extents)


def boxes_meet(a: tuple[Column, Column, Column, Column], b: Box) -> Column:
    """Whether boxes (west, south, east, north) share a point (SRC18)."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def files_in(spark: SparkSession, extents: str, box: Box) -> list[str]:
    """The files that may have places of a box: a list of names, as Spark's own listing of a table has in the driver."""
    meets = boxes_meet(tuple(F.col(c) for c in ("west", "south", "east", "north")), box)
    return sorted(r.file for r in spark.read.parquet(extents).filter(meets).select("file").collect())


def read_box(spark: SparkSession, path: str, extents: str, box: Box) -> DataFrame:
    """Places within a box (west, south, east, north), borders included; only files that may have some are opened."""
    schema = spark.read.parquet(path).schema
    files = files_in(spark, extents, box)
    found = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return found.filter(F.col("latitude").between(box[1], box[3]) & F.col("longitude").between(box[0], box[2]))


def overlay_bounds(stations: DataFrame, margin: float = MARGIN) -> Box | None:
    """Extent of located stations (lat, lon) in web mercator, grown by ``margin``, as degrees (FIL07); None if none is located. One aggregate row comes to the driver."""
    located = stations.filter(geo.valid(F.col("lat"), F.col("lon")))
    x, y = geo.x_3857(F.col("lon")), geo.y_3857(F.col("lat"))
    r = located.agg(F.min(x).alias("w"), F.min(y).alias("s"), F.max(x).alias("e"), F.max(y).alias("n")).first()
    if r.w is None or r.s is None:
        return None
    lon = lambda v: math.degrees(v / geo.WEB_MERCATOR_M)
    lat = lambda v: math.degrees(2 * math.atan(math.exp(v / geo.WEB_MERCATOR_M)) - math.pi / 2)
    return lon(r.w - margin), lat(r.s - margin), lon(r.e + margin), lat(r.n + margin)


def overlay(references: DataFrame, imports: DataFrame, stations: DataFrame, matches: DataFrame) -> DataFrame:
    """References around the stations shown, each with the stations among these that it matches (FIL07).

    references: reference_id, import_id, lat, lon, others; imports: import_id, source_id, country, snapshot_date, created_at, status; stations (those shown): id, country, lat,
    lon; matches: reference_id, station_id. Of each source and country the newest import that succeeded counts, if it has no country or that of a located station.
    Adds ``matched``, sorted, empty where there is none. No row if no station is located.
    """
    shown = stations.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    box = overlay_bounds(shown)
    if box is None:
        return references.limit(0).withColumn("matched", F.array().cast("array<string>"))
    at = F.struct(F.coalesce("snapshot_date", F.lit("1900-01-01").cast("date")), "created_at", "import_id")
    here = shown.select("country").distinct()
    done = imports.filter("status = 'succeeded'")
    done = done.filter("country is null").unionByName(done.join(here, "country", "left_semi").select(done.columns))
    active = done.groupBy("source_id", "country").agg(F.max_by("import_id", at).alias("import_id")).select("import_id").distinct()
    near = references.filter(F.col("lat").between(box[1], box[3]) & F.col("lon").between(box[0], box[2])).join(active, "import_id", "left_semi")
    of = matches.join(shown.select(F.col("id").alias("station_id")), "station_id", "left_semi").join(near.select("reference_id"), "reference_id", "left_semi")
    listed = of.groupBy("reference_id").agg(F.array_sort(F.collect_set(F.col("station_id").cast("string"))).alias("matched"))
    return near.join(listed, "reference_id", "left").withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))
