"""Places by box against brute force, files opened, JSON forms, overlay bounds (SRC16-SRC18, FIL07)."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from junctura import storage
from junctura.sources import places


def test_box_reads_few_files_and_all_rows(spark):
    rng = random.Random(5)
    rows = [(f"p{k}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(1200)] + [(f"h{k}", 47.5, 8.25) for k in range(800)]  # a third and more at one spot
    rows += [("none", None, 8.0), ("far", 91.0, 8.0), ("edge", 90.0, 180.0), ("edge2", -90.0, -180.0)]
    df = spark.createDataFrame(rows, "external_id string, latitude double, longitude double")
    where, extents = storage.new_dir(spark, "places"), storage.new_dir(spark, "extents")
    places.write_laid_out(df, where, extents, rows_per_file=100)
    sizes = [r.n for r in spark.read.parquet(extents).collect()]
    assert sum(sizes) == len(rows) and len(sizes) >= 18 and max(sizes) < 400
    for box in [(8.0, 47.0, 9.0, 48.0), (8.25, 47.5, 8.25, 47.5), (-180, -90, 180, 90), (170, 80, 180, 90), (100.0, 10.0, 100.001, 10.001)]:
        got = sorted(r.external_id for r in places.read_box(spark, where, extents, box).collect())
        assert got == sorted(i for i, lat, lon in rows if lat is not None and box[1] <= lat <= box[3] and box[0] <= lon <= box[2])
    opened = places.read_box(spark, where, extents, (100.0, 10.0, 101.0, 11.0)).inputFiles()
    assert len(opened) <= len(sizes) // 4  # counted, not only fewer rows
    places.write_laid_out(df.limit(0), where + "-empty", extents + "-empty")
    assert places.read_box(spark, where + "-empty", extents + "-empty", (0, 0, 1, 1)).columns == df.columns


def test_curve_keeps_bits(spark):
    bits = lambda x, y: sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(16))
    rows = [(-90.0, -180.0), (90.0, 180.0), (47.1, 8.3), (0.0, 0.0), (None, 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "lat double, lon double").select(places.curve(F.col("lat"), F.col("lon"))).collect()]
    cell = lambda v, low, width: min(math.floor((v - low) / width * 65536), 65535)
    assert got == [None if lat is None else bits(cell(lon, -180, 360), cell(lat, -90, 180)) for lat, lon in rows]


def test_json_forms(spark, tmp_path):
    rows = [
        {"id": 7, "name": " A-b ", "category": "TRAM_STOP", "country": "de", "metadata": {"x": 1}},
        {"external_id": "e", "id": "i", "display_name": "", "primary_name": "P", "primary_category": "train_station", "metadata": "text"},
        {"id": "1", "name": "cafe", "category": "cafe"}, {"id": "2", "name": "x", "basic_category": "airport", "country": "FR"}, {"id": "", "name": "x", "category": "airport"}, {"id": "3", "name": "  ", "category": "airport"},
    ]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    want = [("7", "A-b", "a b", "DE", "TRAM_STOP", "", '{"x": 1}'), ("e", "P", "p", "DE", "", "train_station", "{}")]
    for name in ("a.json", "b.jsonl"):
        got = places.json_places(spark, str(tmp_path / name), "de", array=name == "a.json").collect()
        assert sorted((r.external_id, r.display_name, r.normalized_name, r.country, r.category, r.subtype, r.metadata) for r in got) == want
    assert {r.external_id: r.country for r in places.json_places(spark, str(tmp_path / "b.jsonl")).collect()} == {"7": "DE", "e": "", "2": "FR"}
    (tmp_path / "c.jsonl").write_text("{no json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        places.json_places(spark, str(tmp_path / "c.jsonl")).collect()


def test_overlay_bounds(spark):
    shape = "id string, country string, lat double, lon double"
    west, south, east, north = places.overlay_bounds(spark.createDataFrame([("a", "DE", 47.0, 8.0), ("b", "DE", 48.0, 9.0), ("c", "DE", None, 9.0), ("d", "DE", 99.0, 0.0)], shape))
    degree = 500 / (math.pi * 6378137 / 180)  # of longitude; of latitude it is shorter by the cosine
    assert west == pytest.approx(8 - degree) and east == pytest.approx(9 + degree)
    assert south == pytest.approx(47 - degree * math.cos(math.radians(47)), abs=1e-6) and north == pytest.approx(48 + degree * math.cos(math.radians(48)), abs=1e-6)
    none = spark.createDataFrame([("c", "DE", None, 9.0)], shape)
    assert places.overlay_bounds(none) is None
    references = spark.createDataFrame([("r", 1, 47.0, 8.0), ("old", 0, 47.0, 8.0), ("far", 1, 40.0, 8.0), ("lone", 2, 48.0, 9.0), ("other", 3, 47.5, 8.5)], "reference_id string, import_id long, lat double, lon double")
    imports = spark.createDataFrame([(0, 1, "DE", None, 9, "succeeded"), (1, 1, "DE", "2024-01-01", 1, "succeeded"), (9, 1, "DE", "2025-01-01", 1, "failed"), (2, 1, None, None, 1, "succeeded"), (3, 2, "FR", None, 1, "succeeded")], "import_id long, source_id long, country string, snapshot_date string, created_at long, status string")
    imports = imports.withColumn("snapshot_date", F.col("snapshot_date").cast("date"))
    matches = spark.createDataFrame([("r", "b"), ("r", "a"), ("r", "a"), ("r", "gone")], "reference_id string, station_id string")
    shown = spark.createDataFrame([("a", "DE", 47.0, 8.0), ("b", "DE", 48.0, 9.0)], shape)
    assert {r.reference_id: r.matched for r in places.overlay(references, imports, shown, matches).collect()} == {"r": ["a", "b"], "lone": []}
    assert places.overlay(references, imports, none, matches).count() == 0


def test_box_query_at_its_border(spark, tmp_path):
    """the centre of a box is half the sum of its sides; 8.698 and 8.702 make 8.7, summed in another order a little more."""
    import duckdb

    from junctura.plans import overlay  # noqa: F401
    from junctura.plans.registry import QUERIES, SQL

    con = duckdb.connect()
    con.execute(f"copy (select k::bigint as p_partkey, 'small rod' as p_name, 'Brand#24' as p_brand, 44::int as p_size from range(30000, 32000) r(k)) to '{tmp_path}/part.parquet' (format parquet)")
    con.execute(f"copy (select k::bigint as l_partkey, 1::bigint as l_suppkey from range(30000, 32000) r(k)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    for name in ("part", "lineitem"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    got = {tuple(r) for r in QUERIES["places_by_box"](spark, str(tmp_path)).select("external_id", "latitude", "longitude").collect()}
    assert got == set(con.execute(f"select external_id, latitude, longitude from ({SQL['places_by_box']})").fetchall())
    assert "30466" in {r[0] for r in got}
