"""Literal values of names, distances and ids, and scenarios of the station model."""

import io
import zipfile
import zlib
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from junctura import storage
from junctura.functions import geo, ids, rules, text
from junctura.operators import export, merge_queue, sets, stations
from junctura.sources import netex, tables


def values(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_names(spark):
    t = lambda x: F.lit(x)
    assert values(spark, text.loose_name(t("München Hbf, Abzw. Ost Str.")), text.loose_name(t("Berlin Hbf"), expand=False)) == ["munchen hauptbahnhof abzweig ost strasse", "berlin hbf"]
    assert values(spark, text.tokens(text.loose_name(t("Berlin Bahnhof Steig 02")))) == [["berlin", "steig", "02"]]
    assert values(spark, text.is_generic(t("steig 02")), text.is_generic(t("neuhaus"), F.lit(12)), text.is_generic(t("konstanz fuerstenberg"), F.lit(2))) == [True, True, False]
    sim = lambda a, b: F.round(text.trigram_similarity(t(a), t(b)), 6)
    assert values(spark, sim("word", "two words"), sim("munchen hbf", "munchen hauptbahnhof"), sim("berlin", "berlin ost"), sim("x", "x")) == [0.363636, 0.375, 0.636364, 1.0]
    assert values(spark, text.token_overlap(t("a b c"), t("a b")), text.token_overlap(t(""), t("a"))) == [2 / 3, 0.0]
    assert values(spark, text.sequence_ratio(t("Berlin Ost"), t("berlin west"))) == [SequenceMatcher(None, "berlin ost", "berlin west").ratio()]


def test_geo(spark):
    d = geo.haversine_m(*(F.lit(x) for x in (52.52, 13.405, 52.5201, 13.4051)))
    assert values(spark, F.round(d, 5), geo.haversine_m(F.lit(None).cast("double"), *(F.lit(1.0) for _ in range(3)))) == [13.01625, None]
    n = F.lit(None).cast("double")
    assert values(spark, geo.distance_status(n), geo.distance_score(n), geo.distance_status(F.lit(40)), geo.distance_score(F.lit(40)), geo.distance_status(F.lit(7000)), geo.distance_score(F.lit(7000))) == ["missing", 0.0, "supporting", 1.0, "warning", 0.05]
    assert values(spark, geo.walk_seconds(n), geo.walk_seconds(F.lit(0.0)), geo.walk_seconds(F.lit(5000.0))) == [120, 30, 900]


def test_ids_and_rules(spark):
    assert values(spark, ids.station_id("hard", F.lit("x"))) == ["gstn_171eac8dfb8491a023e11162"]
    assert values(spark, rules.is_iso_date(F.lit("2026-02-23")), rules.is_iso_date(F.lit("2026-02-30")), rules.is_iso_date(F.lit("2026-2-3"))) == [True, False, False]
    assert values(spark, rules.service_instant(F.lit("2024-01-31").cast("date"), F.lit("25:10:00"))) == ["2024-02-01T01:10:00Z"]
    assert ids.canonical_json({"b": 1, "a": [2]}) == '{"a":[2],"b":1}'


def test_child_takes_its_points_coordinates(spark):
    places = spark.createDataFrame(
        [(1, "s", "parent", "P", "DE", None, "t", "h1", 51.302085, 7.930336), (2, "s", "child", "C", "DE", "parent", "t", "h1:0", None, None)],
        "id long, source_id string, ref string, name string, country string, parent_ref string, topo_ref string, hard_id string, lat double, lon double",
    )
    points = spark.createDataFrame([("s", "child", 51.302152, 7.930273), ("s", "child", 51.302017, 7.930426)], "source_id string, place_ref string, lat double, lon double")
    members, found = stations.build(places, points)
    child = members.filter("ref = 'child'").first()
    assert (child.coord_source, child.confidence, child.method) == ("points", "high", "hard_id") and found.count() == 2


def test_cross_border_cluster(spark):
    rows = [(1, "Grenzbahnhof", "DE", 47.570, 9.700, ["a"]), (2, "Grenzbahnhof", "AT", 47.570, 9.709, ["b"]), (3, "Elsewhere", "DE", 50.0, 9.0, ["a"])]
    built = merge_queue.build(spark.createDataFrame(rows, "id long, name string, country string, lat double, lon double, sources array<string>"))
    assert [r.reason for r in built["seeds"].collect()] == ["exact_name"] and built["clusters"].count() == 1
    ev = {r.type: r.status for r in built["evidence"].collect()}
    assert len(ev) == 10 and ev["name_exact"] == "supporting" and ev["country_relation"] == "informational"


def test_maps_merge(spark):
    a, b = F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")), F.create_map(F.lit("y"), F.lit("3"))
    assert values(spark, sets.merged_map(a, b)) == [{"x": "1", "y": "3"}]


def test_archives_are_equal(spark):
    t = {"stops": spark.createDataFrame([("b", "B, x", None), ("a", "A", 1.5)], "stop_id string, stop_name string, stop_lat double")}
    out = []
    for df in (t["stops"], t["stops"].repartition(3)):
        f = io.BytesIO()
        export.write_archive({"stops": df}, {"stops": ["stop_id"]}, f)
        out.append(f.getvalue())
    assert out[0] == out[1] and zipfile.ZipFile(io.BytesIO(out[0])).read("stops.txt") == b'stop_id,stop_name,stop_lat\na,A,1.5\nb,"B, x",\n'
    assert "agency.agency_id" in export.missing_columns(t) and "stops.stop_lon" in export.missing_columns(t)


def test_blocks_of_an_archive(spark):
    assert export.joined_crc(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh") and export.joined_crc(zlib.crc32(b"abc"), 0, 0) == zlib.crc32(b"abc")
    df = spark.range(50).select(F.col("id") % 5, F.concat(F.lit("x,"), F.col("id").cast("string")).alias("x")).toDF("k", "x")
    where = storage.new_dir(spark, "test-blocks")
    found = export.compressed_blocks(df.repartition(3), ["k"], where, rows=7).orderBy("block").collect()
    fs, folder = storage.filesystem(where)
    packed = b"".join(fs.open_input_stream(f"{folder}/{b.block:012d}").read() for b in found) + export.END
    assert len(found) == 8 and zlib.decompress(packed, -15).decode() == "".join(f'{k},"{x}"\n' for k, x in sorted((i % 5, f"x,{i}") for i in range(50)))


XML = """<Publication xmlns="http://www.netex.org.uk/netex"><StopPlace id="SP1"><Name>Test Station</Name><Centroid><Location><Longitude>13.40</Longitude><Latitude>52.52</Latitude></Location></Centroid>
<keyList><KeyValue><Key>uic</Key><Value>8011160</Value></KeyValue></keyList><quays><Quay id="Q1"><Name>Platform 1</Name><PublicCode>1</PublicCode></Quay></quays></StopPlace><StopPlace id="SP1"><Name>Later</Name></StopPlace>
<ServiceJourney id="J1"><calls><Call order="2"><ScheduledStopPointRef ref="B"/><Arrival><Time>10:05:00</Time></Arrival></Call><Call order="1"><ScheduledStopPointRef ref="A"/><Departure><Time>10:00:00</Time></Departure></Call></calls></ServiceJourney></Publication>"""


def test_netex(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("site.xml", XML)
    found = netex.elements(spark, str(tmp_path), netex.PLACES + netex.JOURNEYS)
    places = {r.ref: r for r in netex.stop_places(found, "DE").collect()}
    sp, q = places["SP1"], netex.stop_points(found, "DE").first()
    assert (sp.name, sp.lat, sp.lon, sp.hard_id, sp.grid_id) == ("Test Station", 52.52, 13.4, "8011160", "g142_193") and (q.ref, q.place_ref, q.hard_id) == ("Q1", "SP1", "1")
    times = sorted((r.trip_id, r.stop_sequence, r.stop_ref, r.arrival_time, r.departure_time) for r in netex.stop_times(found).collect())
    assert times == [("J1", 1, "A", "10:00:00", "10:00:00"), ("J1", 2, "B", "10:05:00", "10:05:00")]


def test_tables(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("stops.txt", "﻿stop_id,stop_name\na,A\nb,B\n")
    assert [r.fields for r in tables.gtfs_table(spark, str(tmp_path / "g.zip"), "stops").orderBy("line").collect()] == [{"stop_id": "a", "stop_name": "A"}, {"stop_id": "b", "stop_name": "B"}]
    assert tables.latest_dated(["2024-01-02", "x", "2024-02-01"], "2024-01-31") == "2024-01-02"
    links = spark.createDataFrame([(1, "a_20240101.zip"), (2, "a_202401021200.zip"), (3, "a_20240301.zip")], "seq int, url string")
    assert tables.newest_version(links, "202402010000").first().url == "a_202401021200.zip"
    p = spark.createDataFrame([(1, "Q1", "A", "Point(8.5 47.1)", ""), (2, "Q1", "A", "Point(8.5 47.1)", "halt")], "seq int, entity string, label string, point string, subtype string")
    assert tuple(tables.point_bindings(p).first()) == ("Q1", "A", 47.1, 8.5, "halt")


def test_rows_of_archives_without_dicts():
    """Rows become columns in blocks: blank names, doubled names, short and long rows as DictReader has them."""
    import csv
    import io

    from junctura.sources import tables

    for text in ("a,b\n1,2\n\n3,4\n", 'a,,b\n1,x,"2\n2"\n3\n4,5,6,7\n', "a,b,a\n1,2,3\n4,5\n", "\na,b\n1,2\n", ""):
        want = [(k, {c: v for c, v in r.items() if c and v is not None}) for k, r in enumerate(csv.DictReader(io.StringIO(text, newline="")))]
        rows = csv.reader(io.StringIO(text, newline=""))
        got = [r for b in tables._batches("p", next(rows, []), filter(None, rows), 2) for r in b.to_pylist()]
        assert [(r["line"], dict(r["fields"])) for r in got] == want and all(r["archive"] == "p" for r in got)
