"""Timetables compiled to GTFS tables and a deterministic archive (PIP06, PIP20)."""

from __future__ import annotations

import csv
import io
import shutil
import struct
import uuid
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import storage
from ..functions import rules

#: Rows that one task renders and deflates at once; archives of other sizes of it differ in bytes.
BLOCK_ROWS = 1 << 16
#: The last block of a deflate stream, an empty one.
END = b"\3\0"

#: The export's calendar, as fixed values.
CALENDAR = {"monday": "1", "tuesday": "1", "wednesday": "1", "thursday": "1", "friday": "1", "saturday": "1", "sunday": "1", "start_date": "20240101", "end_date": "20351231"}
#: Columns that each table of an export must have, as fixed values.
REQUIRED = {
    "agency": ("agency_id", "agency_name", "agency_url", "agency_timezone"),
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon"),
    "routes": ("route_id", "agency_id", "route_short_name", "route_type"),
    "trips": ("route_id", "service_id", "trip_id"),
    "stop_times": ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"),
    "calendar": ("service_id", "start_date", "end_date"),
    "transfers": ("from_stop_id", "to_stop_id"),
}


def active_on(start: Column, end: Column, day: Column) -> Column:
    """A window that covers a day; an open side has no end (FIL03)."""
    return (F.coalesce(start, F.lit("1900-01-01").cast("date")) <= day) & (F.coalesce(end, F.lit("2999-12-31").cast("date")) >= day)


def resolved_stop_times(stop_times: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each stop time's station: its own, else its provider's mapping; rows with neither drop out (JON20)."""
    active = mapping.filter("is_active").select("source_id", F.col("ref").alias("stop_ref"), F.col("station_id").alias("mapped"))
    joined = stop_times.join(active, ["source_id", "stop_ref"], "left")
    return joined.withColumn("stop_id", F.coalesce(F.nullif("station_id", F.lit("")), "mapped")).drop("station_id", "mapped").filter("stop_id is not null")


def trip_rows(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Stop times at known stops, numbered from 1, times filled; trips of two stops at least (WIN14)."""
    w = Window.partitionBy("trip_id")
    valid = stop_times.join(stops.select("stop_id").distinct(), "stop_id", "left_semi")
    seq = F.row_number().over(w.orderBy("stop_sequence", "stop_id"))
    numbered = valid.withColumns({"seq": seq, "n": F.count("*").over(w)}).filter("n >= 2")
    arrival = rules.time_or_fallback(F.coalesce("arrival_time", "departure_time"), F.col("seq"))
    departure = rules.time_or_fallback(F.coalesce("departure_time", "arrival_time"), F.col("seq"))
    return numbered.select("trip_id", arrival.alias("arrival_time"), departure.alias("departure_time"), "stop_id", F.col("seq").cast("long").alias("stop_sequence"))


def routes(trips: DataFrame) -> DataFrame:
    """trips: trip_id, route_id, mode, short_name, long_name, headsign, country, seq. One row per route, the last trip's (SET12, FN21, FN23)."""
    tier = rules.trip_tier(F.col("mode"), F.col("short_name"), F.col("long_name"), F.col("headsign"))
    row = F.struct(
        F.concat(F.lit("agency_"), F.lower("country")).alias("agency_id"), F.coalesce(F.nullif("short_name", F.lit("")), "route_id").alias("route_short_name"), F.coalesce(F.nullif("long_name", F.lit("")), F.nullif("short_name", F.lit("")), "route_id").alias("route_long_name"),
        rules.route_type(F.lower("mode")).alias("route_type"), F.concat(F.lit("tier:"), tier).alias("route_desc"),
    )
    return trips.groupBy("route_id").agg(F.max_by(row, F.struct("seq", "trip_id")).alias("r")).select("route_id", "r.*")


def agencies(stops: DataFrame) -> DataFrame:
    """One agency for each country (FN28)."""
    c = F.coalesce(F.nullif(F.trim("country"), F.lit("")), F.lit("EU"))
    found = stops.select(c.alias("country")).distinct()
    return found.select(F.concat(F.lit("agency_"), F.lower("country")).alias("agency_id"), F.concat(F.lit("Transit "), "country").alias("agency_name"), F.lit("https://example.org").alias("agency_url"), rules.country_zone(F.col("country")).alias("agency_timezone"))


def integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """Dangling references by relation (JON25): relation, dangling."""
    checks = [
        ("routes_agency", "routes", "agency_id", "agency", "agency_id"), ("trips_route", "trips", "route_id", "routes", "route_id"), ("trips_service", "trips", "service_id", "calendar", "service_id"), ("stop_times_trip", "stop_times", "trip_id", "trips", "trip_id"),
        ("stop_times_stop", "stop_times", "stop_id", "stops", "stop_id"), ("transfers_from", "transfers", "from_stop_id", "stops", "stop_id"), ("transfers_to", "transfers", "to_stop_id", "stops", "stop_id"), ("trips_without_stop_times", "trips", "trip_id", "stop_times", "trip_id"),
    ]
    out = None
    for name, child, key, parent, of in checks:
        if child in tables and parent in tables:
            right = tables[parent].select(F.col(of).alias("_k"))
            found = tables[child].join(right, tables[child][key] == right["_k"], "left_anti").agg(F.count("*").alias("dangling")).select(F.lit(name).alias("relation"), "dangling")
            out = found if out is None else out.unionByName(found)
    return out


def missing_columns(tables: dict[str, DataFrame]) -> list[str]:
    return [f"{t}.{c}" for t, cols in REQUIRED.items() for c in cols if t not in tables or c not in tables[t].columns]


def _product(a: int, b: int) -> int:
    """Of two polynomials of CRC-32, lowest power in the highest bit."""
    out = 0
    for k in range(31, -1, -1):
        out ^= b if a >> k & 1 else 0
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two texts in a row from those of each and the second one's length."""
    power, square = 1 << 31, 1 << 23
    while length:
        power, square, length = _product(square, power) if length & 1 else power, _product(square, square), length >> 1
    return _product(power, first) ^ second


def _csv(rows) -> bytes:
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    return text.getvalue().encode()


def _deflated(raw: bytes) -> bytes:
    """A run of raw deflate that ends on a byte and is not the last."""
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    return z.compress(raw) + z.flush(zlib.Z_SYNC_FLUSH)


def compressed_blocks(df: DataFrame, keys: list[str], where: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Writes a table's CSV lines, sorted by keys and then all columns, as deflated blocks to files of a shared folder: block, crc, raw, packed (bytes).

    Blocks hold a fixed number of rows, numbered from prefix sums over sorted partitions, so they are equal for equal tables however Spark deals them. A task that runs again
    writes the same file.
    """
    spark, cols = df.sparkSession, df.columns
    order = [*(F.col(k).asc_nulls_first() for k in keys), *(F.col(c).cast("string").asc_nulls_first() for c in cols if c not in keys)]
    ranged = df.repartitionByRange(storage.shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    line = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    placed = storage.stored(ranged.select(line.alias("line"), F.monotonically_increasing_id().alias("at")), "export").withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)})
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("base"))  # one row for each partition
    blocks = placed.join(F.broadcast(bases), "part").select("line", (F.col("base") + F.col("at")).alias("at")).withColumn("block", F.floor(F.col("at") / rows))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        raw = _csv(group.sort_values("at")["line"])
        packed, block = _deflated(raw), int(group["block"].iloc[0])
        fs, folder = storage.filesystem(where)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{block:012d}") as f:
            f.write(packed)
        return pd.DataFrame({"block": [block], "crc": [zlib.crc32(raw)], "raw": [len(raw)], "packed": [len(packed)]})

    return blocks.groupBy("block").applyInPandas(pack, "block long, crc long, raw long, packed long")


class Archive:
    """A ZIP that is written from front to back: tables that tasks render, and members that are copied as they lie in another archive."""

    def __init__(self, out: io.IOBase, date: tuple = (2024, 1, 1, 0, 0, 0)):
        self.out, self.date, self.central, self.at = out, date, [], 0

    def _member(self, name: str, date: tuple, method: int, flags: int, crc: int, raw: int, packed: int) -> None:
        """The local header; what follows has ``packed`` bytes."""
        file = name.encode()
        stamp = ((date[0] - 1980) << 9 | date[1] << 5 | date[2]) << 16 | date[3] << 11 | date[4] << 5 | date[5] // 2
        sizes = struct.pack("<HHQQ", 1, 16, raw, packed)
        local = struct.pack("<4sHHHIIIIHH", b"PK\3\4", 45, flags, method, stamp, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(file), len(sizes)) + file + sizes
        self.out.write(local)
        extra = struct.pack("<HHQQQ", 1, 24, raw, packed, self.at)
        self.central.append(struct.pack("<4sHHHHIIIIHHHHHII", b"PK\1\2", 3 << 8 | 45, 45, flags, method, stamp, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(file), len(extra), 0, 0, 0, 0o100644 << 16, 0xFFFFFFFF) + file + extra)
        self.at += len(local) + packed

    def table(self, name: str, df: DataFrame, keys: list[str]) -> None:
        """A CSV file of a table, sorted by keys and then all columns."""
        spark, head = df.sparkSession, _csv([df.columns])
        where = storage.new_dir(spark, "export")
        found = storage.stored(compressed_blocks(df, keys, where), "export-blocks").orderBy("block")
        crc, raw, start = zlib.crc32(head), len(head), _deflated(head)
        packed = len(start) + len(END)
        for b in found.toLocalIterator():  # a row for each block
            crc, raw, packed = joined_crc(crc, b.crc, b.raw), raw + b.raw, packed + b.packed
        self._member(name, self.date, 8, 0x800, crc, raw, packed)
        self.out.write(start)
        fs, folder = storage.filesystem(where)
        for b in found.select("block").toLocalIterator():
            with fs.open_input_stream(f"{folder}/{b.block:012d}") as f:
                shutil.copyfileobj(f, self.out, 1 << 20)
        self.out.write(END)
        storage.drop(spark, where)

    def copy(self, source, member: zipfile.ZipInfo) -> None:
        """A member of another archive, byte by byte: nothing is inflated, lengths and CRC are those of its directory."""
        source.seek(member.header_offset)
        head = source.read(30)
        if head[:4] != b"PK\3\4":
            raise zipfile.BadZipFile(f"{member.filename}: no member where the directory has one")
        source.seek(member.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
        # sizes stand before the member now, and names are UTF-8
        self._member(member.filename, member.date_time, member.compress_type, member.flag_bits & ~0x8 | 0x800, member.CRC, member.file_size, member.compress_size)
        left = member.compress_size
        while left:
            part = source.read(min(left, 1 << 20))
            if not part:
                raise zipfile.BadZipFile(f"{member.filename}: the archive ends too early")
            self.out.write(part)
            left -= len(part)

    def close(self) -> None:
        listing = b"".join(self.central)
        n = len(self.central)
        self.out.write(listing + struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(listing), self.at) + struct.pack("<4sIQI", b"PK\6\7", 0, self.at + len(listing), 1))
        self.out.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(len(listing), 0xFFFFFFFF), 0xFFFFFFFF, 0))


def write_archive(tables: dict[str, DataFrame], order: dict[str, list[str]], out: io.IOBase, date: tuple = (2024, 1, 1, 0, 0, 0)) -> None:
    """A ZIP of CSV files, equal for equal tables (SNK01, SNK02). Rows without values but one column of theirs are blank lines in quotes, as CSV has them.

    Tasks sort, render and deflate blocks of rows; the writer of the one file only joins these, with lengths and CRCs that follow from theirs.
    """
    z = Archive(out, date)
    for name, keys in order.items():
        z.table(f"{name}.txt", tables[name], keys)
    z.close()


def rewrite_archive(source: str, target: str, tables: dict[str, DataFrame], order: dict[str, list[str]]) -> None:
    """An archive with some tables replaced (SNK03): members that are not among them are copied as they lie, in their place and with their dates.

    source and target are URIs. A table's member is found by its file name in any folder, without ``.txt``; tables that the source lacks follow at the end, in order. The target
    appears when it is whole, by a rename.
    """
    (fs, at), (to_fs, to) = storage.filesystem(source), storage.filesystem(target)
    made, seen = f"{to}.{uuid.uuid4().hex}", set()
    to_fs.create_dir(to.rpartition("/")[0], recursive=True)
    with fs.open_input_file(at) as f, to_fs.open_output_stream(made) as out:
        z = Archive(out)
        with zipfile.ZipFile(f) as listing:
            members = listing.infolist()
        for m in members:
            name = m.filename.rpartition("/")[2].removesuffix(".txt")
            if m.filename.endswith(".txt") and name in order:
                z.table(m.filename, tables[name], order[name])
                seen.add(name)
            else:
                z.copy(f, m)
        for name in order:
            if name not in seen:
                z.table(f"{name}.txt", tables[name], order[name])
        z.close()
    to_fs.move(made, to)
