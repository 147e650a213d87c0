"""NeTEx archives: entries, cascades, references as of an entry, patterns."""

import io
import zipfile

import pytest

from junctura.operators import network
from junctura.sources import netex, netex_entries

HEAD = '<?xml version="1.0"?><Publication xmlns="http://www.netex.org.uk/netex"><dataObjects>'


def archive(where, name="a.zip", method=zipfile.ZIP_DEFLATED, **entries):
    with zipfile.ZipFile(where / name, "w", method) as z:
        for entry, xml in entries.items():
            z.writestr(f"{entry}.xml", f"{HEAD}{xml}</dataObjects></Publication>")
    return str(where)


def assigned(point, **refs):
    return f'<PassengerStopAssignment id="A"><ScheduledStopPointRef ref="{point}"/>{"".join(f"<{k} ref={chr(34)}{v}{chr(34)}/>" for k, v in refs.items())}</PassengerStopAssignment>'


def test_points(spark, tmp_path):
    spot = "<Location><Longitude>{1}</Longitude><Latitude>{0}</Latitude></Location>"
    first = f"""
      <StopPlace id="P1"><Name>One</Name><Centroid>{spot.format(50, 10)}</Centroid>
        <quays><Quay id="Q1"><Name>Platform</Name><a><b>{spot.format(999, 10)}{spot.format(51, 11)}</b></a></Quay><Quay id="Q2"/></quays></StopPlace>
      <StopPlace id="P2"><Descriptor><Name>Two</Name></Descriptor><quays><Quay id="Q3"><ParentSiteRef ref="P1"/></Quay></quays></StopPlace>
      <StopPlace id="P9"/>
      <Quay id="Q4"><keyList><KeyValue><Key>StopPlaceRef</Key><Value>P2</Value></KeyValue></keyList><StopPlaceRef ref="P1"/></Quay>
      <Quay id="Q5"><Name>led</Name><QuayRef ref="Q4"/></Quay>
      <ScheduledStopPoint id="S1"/>{assigned("S1", StopPlaceRef="P1")}{assigned("S1", QuayRef="Q4")}
      <ScheduledStopPoint id="S2"/>{assigned("S2", QuayRef="Q9")}
      <ScheduledStopPoint id="S3"><Name>alone</Name><PublicCode>7</PublicCode></ScheduledStopPoint>
      <ScheduledStopPoint id="S4"/>"""
    # a later entry tells of S2 and S4 too late, and again of the quay Q3 and of S3
    second = f"""<Quay id="Q3"><StopPlaceRef ref="P2"/></Quay>{assigned("S4", StopPlaceRef="P1")}<StopPlace id="P1"><Name>Other</Name></StopPlace>
      <ScheduledStopPoint id="S4"/><ScheduledStopPoint id="S5"/>{assigned("S5", StopPlaceRef="P1")}"""
    where = archive(tmp_path, "a.zip", stop_1=first, stop_2=second)
    archive(tmp_path, "b.zip", zipfile.ZIP_STORED, stop='<StopPlace id="P1"><Name>of another archive</Name></StopPlace>')
    found = netex.elements(spark, where, netex.PLACES)
    places = {(r.file[-5:], r.ref): r for r in netex.stop_places(found, "DE").collect()}
    assert {k: r.name for k, r in places.items()} == {("a.zip", "P1"): "One", ("a.zip", "P2"): "Two", ("b.zip", "P1"): "of another archive"}
    assert places["a.zip", "P1"].lat == 50 and places["a.zip", "P2"].lat is None  # a place's quays are not where it is
    points = {r.ref: (r.place_ref, r.name, r.lat, r.hard_id) for r in netex.stop_points(found, "DE").collect()}
    assert points == {
        "Q1": ("P1", "Platform", 51, None), "Q2": ("P1", "One", 50, None), "Q3": ("P1", "One", 50, None), "Q4": ("P2", "Two", None, "P2"), "Q5": ("P2", "led", None, None),
        "S1": ("P2", "Two", None, None), "S3": ("S3", "alone", None, "7"), "S4": ("P1", "One", 50, None), "S5": ("P1", "One", 50, None),
    }


def test_limits(spark, tmp_path, monkeypatch):
    where = archive(tmp_path, site="<StopPlace id='P'><Name>x</Name></StopPlace>", other="<StopPlace id='N'><Name>not read</Name></StopPlace>")
    assert [r.ref for r in netex.stop_places(netex.elements(spark, where, netex.PLACES), "DE").collect()] == ["P"]
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        monkeypatch.setattr(netex_entries, "MOST_ENTRY_BYTES", 10)
        with pytest.raises(ValueError, match="bytes"):
            netex_entries.chosen(z, "stops")
        monkeypatch.undo()
        monkeypatch.setitem(netex_entries.USES, "stops", (*netex_entries.STOPS[:3], 0))
        with pytest.raises(ValueError, match="allowed"):
            netex_entries.chosen(z, "stops")
    monkeypatch.undo()
    monkeypatch.setattr(netex_entries, "PEEK_FROM", 1)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for n, text in (("b.xml", "<a/>"), ("a.xml", "<SiteFrame/>"), ("c.txt", "<StopPlace/>")):
            z.writestr(n, text)
    with zipfile.ZipFile(held) as z:
        assert [e.filename for e in netex_entries.chosen(z, "stops")] == ["a.xml"]
        assert [e.filename for e in netex_entries.chosen(z, "timetable")] == ["a.xml", "b.xml"]


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_stream(tmp_path, method):
    """Elements come in order with little held; a wrong byte is an error."""
    archive(tmp_path, "a.zip", method, line="".join(f'<noise><deep>{"x" * 500}</deep></noise><Line id="L{k}"><Name>n{k}</Name></Line>' for k in range(2000)))
    data = (tmp_path / "a.zip").read_bytes()
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        e = z.infolist()[0]
    f = netex_entries.Inflated(io.BytesIO(data), e.header_offset, e.compress_size, e.compress_type, e.CRC)
    assert [i for i, _ in enumerate(netex_entries.streamed(f, ("Line",)))][-1] == 1999
    with pytest.raises(zipfile.BadZipFile):
        list(netex_entries.streamed(netex_entries.Inflated(io.BytesIO(data), e.header_offset, e.compress_size, e.compress_type, e.CRC ^ 1), ("Line",)))


def test_patterns(spark, tmp_path):
    stop = lambda n, s: f'<StopPointInJourneyPattern id="{n}{s}" order="{n}"><ScheduledStopPointRef ref="{s}"/></StopPointInJourneyPattern>'
    pattern = lambda i, *stops: f'<ServiceJourneyPattern id="{i}"><RouteView><LineRef ref="L1"/></RouteView>{"".join(stop(n, s) for n, s in stops)}</ServiceJourneyPattern>'
    first = pattern("p1", (3, "c"), (1, "a"), (2, "b"), (0, "zero"), (-1, "less"), ("x", "none")) + pattern("p2", (1, "a"), (5, "b"), (9, "c")) + pattern("p3", (0, "a")) + assigned("a", QuayRef="Q") + assigned("b", StopPlaceRef="P", QuayRef="Q")
    second = pattern("p4", (1, "a"), (2, "b"), (3, "c")) + '<Line id="L1"><ShortName>S</ShortName></Line><JourneyPattern id="j"><LineRef ref="L1"/>' + stop(1, "a") + stop(2, "d") + '</JourneyPattern><ServiceJourney id="s"><Call order="2"><StopPlaceRef ref="y"/></Call><Call order="1"><StopPointRef ref="x"/></Call></ServiceJourney>'
    found = netex.elements(spark, archive(tmp_path, x_line_1=first, x_line_2=second, x_common_1=pattern("no", (1, "a"))), netex.PATTERNS, "network")
    kept = network.deduplicated_patterns(netex.patterns(found))
    assert sorted((r.pattern_id, r.tag, r.entry_index, r.label, *r.refs) for r in kept.collect()) == [("j", "JourneyPattern", 1, "S", "a", "d"), ("p1", "ServiceJourneyPattern", 0, "p1", "a", "b", "c"), ("s", "ServiceJourney", 1, "s", "x", "y")]
    steps = netex.pattern_steps(found, kept)
    assert sorted((r.place, r.label, r.hits) for r in network.pattern_routes(steps).collect()) == [("Q", "p1", 1), ("synthetic:a", "S", 1), ("synthetic:c", "p1", 1), ("synthetic:d", "S", 1), ("synthetic:x", "s", 1), ("synthetic:y", "s", 1)]
    assert sorted((r.from_place, r.to_place) for r in network.pattern_adjacency(steps).collect()) == [("Q", "synthetic:c"), ("synthetic:a", "synthetic:d"), ("synthetic:x", "synthetic:y")]


def test_archives_are_read_once(spark, tmp_path):
    """What is made of the elements does not open the archives again."""
    line = '<Line id="L1"><Name>Long</Name></Line><ServiceJourneyPattern id="P"><RouteView><LineRef ref="L1"/></RouteView></ServiceJourneyPattern><ServiceJourney id="J"><ServiceJourneyPatternRef ref="P"/></ServiceJourney>'
    found = netex.elements(spark, archive(tmp_path, line=line), netex.JOURNEYS, "timetable")
    (tmp_path / "a.zip").unlink()
    assert [(r.trip_id, r.route_id, r.route_long_name) for r in netex.trips(found).collect()] == [("J", "L1", "Long")]


def test_parts_follow_lines(spark, tmp_path, monkeypatch):
    """Shuffles of the timetable queries have parts by the number of lines."""
    from junctura.plans import archives

    spark.range(20).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(archives, "PART_ROWS", 2)
    with archives._parts(lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "10"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
