"""Other sources: delimited, JSON and Parquet tables, GTFS archives, manifests (SRC12-SRC25)."""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import storage

#: Feature codes of stations in a gazetteer, as fixed values.
STATION_CODES = ("RSTN", "RSTP", "RSTNQ", "STNF", "BUSTN", "MTRST", "MTRO", "RSTNB", "HSTS", "AIRP", "FY")
GAZETTEER = "geonameid long, name string, asciiname string, alternatenames string, latitude double, longitude double, feature_class string, feature_code string, country_code string"


def latest_dated(names: list[str], as_of: str | None = None) -> str | None:
    """The newest name of the form YYYY-MM-DD up to a date (SRC12)."""
    dated = [n for n in names if re.fullmatch(r"\d{4}-\d{2}-\d{2}", n) and (as_of is None or n <= as_of)]
    return max(dated, default=None)


def newest_version(links: DataFrame, cutoff: str) -> DataFrame:
    """The link with the greatest stamp of 12 digits, or 8 and 0000, up to a cutoff, ties to the later one; else the first (SRC13). links: seq, url."""
    twelve, eight = F.regexp_extract("url", r"(?<!\d)(\d{12})(?!\d)", 1), F.regexp_extract("url", r"(?<!\d)(\d{8})(?!\d)", 1)
    stamp = F.when(twelve != "", twelve).when(eight != "", F.concat(eight, F.lit("0000")))
    dated = links.withColumn("stamp", stamp)
    return dated.agg(F.coalesce(F.max_by("url", F.when(F.col("stamp") <= cutoff, F.struct("stamp", "seq"))), F.min_by("url", "seq")).alias("url"))


def manifest(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """path, size, sha256, as_of of files (SRC14)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.lit(as_of).alias("as_of"))


def gazetteer(spark: SparkSession, path: str, countries: list[str]) -> DataFrame:
    """Stations of a tab-separated gazetteer (SRC15); the filters reach the scan."""
    df = spark.read.csv(path, sep="\t", schema=GAZETTEER, quote="")
    return df.filter(F.col("country_code").isin(*countries) & (F.col("feature_code").isin(*STATION_CODES) | ((F.col("feature_class") == "S") & F.col("feature_code").contains("STN"))))


def point_bindings(df: DataFrame) -> DataFrame:
    """seq, entity, label, point, subtype with texts of the form Point(lon lat): one row per entity, the first non-empty subtype (SRC19)."""
    number = lambda k: F.regexp_extract("point", r"Point\((-?[0-9.eE+-]+) (-?[0-9.eE+-]+)\)", k).try_cast("double")
    rows = df.withColumns({"lon": number(1), "lat": number(2)}).filter("lat is not null and lon is not null")
    return rows.groupBy("entity").agg(F.min_by("label", "seq").alias("label"), F.min_by("lat", "seq").alias("lat"), F.min_by("lon", "seq").alias("lon"), F.min_by("subtype", F.when(F.coalesce("subtype", F.lit("")) != "", F.col("seq"))).alias("subtype"))


def json_rows(text: Column) -> Column:
    """Rows of a JSON array of references, for inline() (SRC22)."""
    return F.from_json(text, "array<struct<external_id:string,display_name:string,normalized_name:string,country:string,latitude:double,longitude:double,category:string>>")


def json_ids(text: Column) -> Column:
    """Ids of a JSON array, for explode() (SRC23)."""
    return F.from_json(text, "array<string>")


def csv_table(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A CSV file with a header; fails if a required column is missing (SRC21, SRC25)."""
    df = spark.read.csv(path, header=True)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _batches(path: str, head: list[str], rows: Iterator[list[str]], n: int = 10_000) -> Iterator[pa.RecordBatch]:
    """archive, line, fields of rows under a header. Columns without a name, and values that a row lacks or has no column for, are left out; of columns of one name the last counts."""
    at, places = 0, {c: k for k, c in enumerate(head) if c}  # the last of each name, where the first stands
    alike = list(places.values()) == list(range(len(head)))
    while some := list(itertools.islice(rows, n)):
        if alike and all(len(r) == len(head) for r in some):
            offsets, keys, values = range(0, len(some) * len(head) + 1, len(head)), head * len(some), list(itertools.chain.from_iterable(some))
        else:
            told = [{c: r[k] for c, k in places.items() if k < len(r)} for r in some]
            offsets = list(itertools.accumulate(map(len, told), initial=0))
            keys, values = [c for r in told for c in r], [v for r in told for v in r.values()]
        fields = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array(range(at, at + len(some)), pa.int64()), fields], names=["archive", "line", "fields"])
        at += len(some)


def gtfs_table(spark: SparkSession, archives: str, table: str) -> DataFrame:
    """archive, line number and fields (map) of one table of GTFS archives (SRC24). Spark lists the archives; each is opened in place by a task and its rows stream out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            fs, at = storage.filesystem(path)
            with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                if f"{table}.txt" not in z.namelist():
                    continue
                with z.open(f"{table}.txt") as raw:
                    rows = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
                    yield from _batches(path, next(rows, []), filter(None, rows))

    return spark.read.format("binaryFile").load(archives).select("path").mapInArrow(run, "archive string, line long, fields map<string,string>")
