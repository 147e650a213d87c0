"""A Spark data source over NeTEx archives: one row for each element of the kinds asked for.

The driver reads only the directories of archives. A partition holds one entry, or several small ones; its task reads the entry's bytes by range,
inflates them as a stream and drops each element when it has been turned into a row, so neither archives nor entries are ever held whole.
An entry over ``MOST_ENTRY_BYTES`` or more entries than the rules allow are errors, as is a wrong check sum.
"""

from __future__ import annotations

import functools
import itertools
import json
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: what tells entries by name and, where an archive has over 500 entries without such names, by their first bytes
STOPS = (("site", "stop", "station", "service", "common"), (b"StopPlace", b"SiteFrame", b"ScheduledStopPoint", b"PassengerStopAssignment"), 8192, 50_000)
TIMETABLE = (("timetable", "line", "service", "journey"), (), 0, 120_000)
NETWORK = ((), (b"ServiceJourneyPattern", b"JourneyPattern", b"TemplateServiceJourney", b"ServiceJourney", b"PassengerStopAssignment", b"ScheduledStopPointRef", b"<Line"), 32768, 120_000)
USES = {"stops": STOPS, "timetable": TIMETABLE, "network": NETWORK}
MOST_ENTRY_BYTES = 1_000_000_000
PEEK_FROM = 500
PLACES = ("StopPlace", "Quay", "ScheduledStopPoint")
PATTERNS = ("ServiceJourneyPattern", "JourneyPattern", "ServiceJourney", "TemplateServiceJourney")

#: Bytes of small entries that share a partition.
PARTITION_BYTES = 32 << 20
ROWS = 1000
SCHEMA = "file string, entry string, entry_index int, event int, kind string, ancestor string, doc string"


@dataclass
class Entries(InputPartition):
    """name, index, offset, compressed bytes, method, CRC of entries of one archive."""

    uri: str
    entries: list[tuple[str, int, int, int, int, int]]


def _named(name: str, use: str) -> bool:
    low = name.rpartition("/")[2].lower()
    if use != "network":
        return any(w in low for w in USES[use][0])
    if any(w in low for w in ("servicecalendar", "_common_", "_resource_", "_site_")):
        return False
    return any(w in low for w in ("timetable", "journey", "offer", "_line_", "_service_")) or low.endswith(("_line.xml", "_service.xml"))


def chosen(z: zipfile.ZipFile, use: str) -> list[zipfile.ZipInfo]:
    """Entries that may hold what is asked for, in order of name (SRC01): by name; else all of a small archive; else by first bytes; else all."""
    _, marks, peek, most = USES[use]
    xml = sorted((e for e in z.infolist() if e.filename.lower().endswith(".xml")), key=lambda e: e.filename)
    if not xml:
        raise ValueError(f"{z.filename}: no XML entries")
    found = [e for e in xml if _named(e.filename, use)]
    if not found and marks and len(xml) > PEEK_FROM:
        for e in xml:
            with z.open(e) as f:
                head = f.read(peek)
            if any(m in head for m in marks):
                found.append(e)
    found = found or xml
    if len(found) > most:
        raise ValueError(f"{len(found)} entries to read; {most} are allowed")
    for e in found:
        if e.file_size > MOST_ENTRY_BYTES:
            raise ValueError(f"entry {e.filename} has {e.file_size} bytes; {MOST_ENTRY_BYTES} are allowed")
    return found


class Inflated:
    """An entry's text, read from its range of the archive."""

    def __init__(self, f, offset: int, size: int, method: int, crc: int):
        f.seek(offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise zipfile.BadZipFile("no entry where the directory has one")
        f.seek(offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
        self.f, self.left, self.want, self.crc = f, size, crc, 0
        self.inflate = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
        self.rest = b""

    def read(self, n: int = 1 << 16) -> bytes:
        out = b""
        while not out:
            data = self.rest or self.f.read(min(n, self.left))
            self.left -= 0 if self.rest else len(data)
            if not data:
                if self.crc != self.want:
                    raise zipfile.BadZipFile("wrong check sum")
                return b""
            out, self.rest = (self.inflate.decompress(data, n), self.inflate.unconsumed_tail) if self.inflate else (data, b"")
        self.crc = zlib.crc32(out, self.crc)
        return out


@functools.lru_cache(4096)
def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(e: ElementTree.Element | None) -> str:
    return ((e.text if e is not None else None) or "").strip()


def _child(e: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((c for c in e if _name(c.tag) == name), None)


def _within(e: ElementTree.Element, name: str, skip: tuple[str, ...] = ()) -> Iterator[ElementTree.Element]:
    """Elements of a name below, in document order; what stands in an element of the names to skip doesn't count."""
    for c in e:
        if _name(c.tag) == name:
            yield c
        if _name(c.tag) not in skip:
            yield from _within(c, name, skip)


def _refs(e: ElementTree.Element) -> dict[str, str]:
    out: dict[str, str] = {}
    for c in e:
        ref = (c.get("ref") or "").strip()
        if ref:
            out.setdefault(_name(c.tag), ref)
    return out


def _below(e: ElementTree.Element, *names: str) -> dict[str, list[ElementTree.Element]]:
    """Elements of each name below, in document order, by one pass."""
    found: dict[str, list[ElementTree.Element]] = {n: [] for n in names}
    for c in e.iter():
        held = found.get(_name(c.tag))
        if held is not None and c is not e:
            held.append(c)
    return found


def _point(e: ElementTree.Element) -> dict:
    first: dict[str, ElementTree.Element] = {}
    ref: dict[str, str] = {}
    for c in e:
        name = _name(c.tag)
        first.setdefault(name, c)
        to = (c.get("ref") or "").strip()
        if to:
            ref.setdefault(name, to)
    times = []
    for x in ("Arrival", "Departure"):
        called = first.get(x) if _name(e.tag) == "Call" else None
        times.append((_text(_child(called, "Time")) if called is not None else "") or _text(first.get(f"{x}Time")))
    return {"id": (e.get("id") or "").strip(), "order": (e.get("order") or "").strip(), "ref": ref, "arrival": times[0], "departure": times[1]}


def described(e: ElementTree.Element) -> dict:
    """What rows need of an element: id, texts and references of its children, and by kind key values, locations, points, calls, passing times, days."""
    kind = _name(e.tag)
    text: dict[str, str] = {}
    for c in e:
        if _text(c):
            text.setdefault(_name(c.tag), _text(c))
    out: dict = {"id": (e.get("id") or "").strip() or None, "text": text, "ref": _refs(e)}
    if kind in PLACES:
        descriptor = _child(e, "Descriptor")
        out["descriptor"] = _text(_child(descriptor, "Name")) if descriptor is not None else ""
        pairs = [(_text(_child(p, "Key")).lower(), _text(_child(p, "Value"))) for p in _within(e, "KeyValue", PLACES)]
        out["kv"] = {k: v for k, v in pairs if k and v}
        out["at"] = [[_text(_child(p, x)) for x in ("Latitude", "Longitude")] for p in _within(e, "Location", PLACES)]
    if kind in PATTERNS:
        below = _below(e, "RouteView", "StopPointInJourneyPattern", "Call", "TimetabledPassingTime")
        out["view"] = _refs(below["RouteView"][0]).get("LineRef") if below["RouteView"] else None
        for field, name in (("points", "StopPointInJourneyPattern"), ("calls", "Call"), ("passing", "TimetabledPassingTime")):
            out[field] = [_point(p) for p in below[name]]
        for field, group, name in (("days", "dayTypes", "DayTypeRef"), ("conditions", "validityConditions", "AvailabilityConditionRef")):
            held = _child(e, group)
            out[field] = [(c.get("ref") or "").strip() for c in (held if held is not None else ()) if _name(c.tag) == name and (c.get("ref") or "").strip()]
    return out


def streamed(f, kinds: tuple[str, ...]) -> Iterator[tuple[str, str, str]]:
    """Kind, id of the place around it, and description (JSON) of elements in the order in which they end; memory holds one outermost element of the kinds."""
    above: list[ElementTree.Element] = []
    inside, around = 0, [""]
    for event, e in ElementTree.iterparse(f, ("start", "end")):
        kind = _name(e.tag)
        if event == "start":
            above.append(e)
            inside += kind in kinds
            if kind == "StopPlace":
                around.append((e.get("id") or "").strip())
            continue
        above.pop()
        if kind == "StopPlace":
            around.pop()
        if kind in kinds:
            inside -= 1
            yield kind, around[-1], json.dumps(described(e), ensure_ascii=False)
            if kind in PLACES:
                e.clear()
        if not inside and above:
            above[-1].remove(e)


class NetexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.use, self.kinds = json.loads(options["paths"]), options["use"], tuple(options["kinds"].split(","))

    def partitions(self) -> list[Entries]:
        out = []
        for uri in self.paths:
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                held, size = [], 0
                for k, e in enumerate(chosen(z, self.use)):
                    if held and size + e.compress_size > PARTITION_BYTES:
                        out.append(Entries(uri, held))
                        held, size = [], 0
                    held.append((e.filename, k, e.header_offset, e.compress_size, e.compress_type, e.CRC))
                    size += e.compress_size
                out.append(Entries(uri, held))
        return out

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(partition.uri)
        schema = pa.schema([("file", pa.string()), ("entry", pa.string()), ("entry_index", pa.int32()), ("event", pa.int32()), ("kind", pa.string()), ("ancestor", pa.string()), ("doc", pa.string())])
        with fs.open_input_file(path) as f:
            for name, index, offset, size, method, crc in partition.entries:
                rows = ((partition.uri, name, index, k, *row) for k, row in enumerate(streamed(Inflated(f, offset, size, method, crc), self.kinds)))
                while some := list(itertools.islice(rows, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


class NetexSource(DataSource):
    """spark.read.format("netex"); options: paths (JSON list of URIs), use (stops, timetable, network), kinds (comma-separated element names)."""

    @classmethod
    def name(cls) -> str:
        return "netex"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NetexReader:
        return NetexReader(self.options)


def read(spark: SparkSession, paths: list[str], use: str, kinds: tuple[str, ...]) -> DataFrame:
    """Elements of the archives; event is their order of ending in the entry, ancestor the id of the place around them or blank."""
    spark.dataSource.register(NetexSource)
    return spark.read.format("netex").options(paths=json.dumps(paths), use=use, kinds=",".join(kinds)).load()


def archives(folder: str) -> list[str]:
    """URIs of the ZIP files of a folder, by name."""
    fs, path = pafs.FileSystem.from_uri(folder)
    scheme = folder.partition("://")[0] if "://" in folder else "file"
    files = fs.get_file_info(pafs.FileSelector(path))
    return sorted(f"{scheme}://{f.path}" for f in files if f.path.lower().endswith(".zip"))
