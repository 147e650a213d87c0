"""WARC archives: writing with revisit records, and a salvage reader.

A record is a gzip member of its own. Of pages with equal payloads of at least 100 bytes, the one with the smallest page_id is
a response, the others revisit it and carry no payload.

The reader checks each record: member, version line, header, length, end mark, payload digest. After a failed check it searches
for the next valid member or version line, whichever comes first and whatever the archive was before, goes on there, and logs the bytes between as a quarantined gap. It holds one member at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import storage

LEAST_REVISIT = 100
#: Digests (64 characters each) that are broadcast at most.
BROADCAST_ROWS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
START = re.compile(re.escape(MAGIC) + b"|" + re.escape(VERSION))
_CHUNK = 1 << 16


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = f"urn:uuid:{uuid.uuid4()}" if page_id is None else f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        *([] if refers_to is None else [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode(errors="replace") + block + b"\r\n\r\n"


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to. Null html counts as empty. A null page_id never is what others refer to."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    big = F.octet_length("html") >= LEAST_REVISIT
    firsts = rows.filter(big).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    # where few digests repeat, pages are not shuffled
    few = firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(firsts) if few else firsts, "digest", "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    # what revisits needs no text; its length stays
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, uri: str, file_bytes: int = 1 << 28, date: str = "2020-01-01T00:00:00Z") -> str:
    """Write pages (page_id, url, html; other columns are ignored) as gzip-compressed archives under ``uri``; returns ``uri``.

    Files are cut at about ``file_bytes``. Rows that repeat a page_id are records each. Files of failed attempts are in no list.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = storage.filesystem(uri)
        fs.create_dir(at, recursive=True)
        out, name, size, done = None, "", 0, []
        for b in batches:
            refers = b["refers_to"].astype("Int64")
            for page_id, url, html, digest, ref in zip(b["page_id"].astype("Int64"), b["url"], b["html"], b["digest"], refers):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                plain = _record(None if page_id is pd.NA else int(page_id), url, html.encode(errors="replace"), digest, None if ref is pd.NA else int(ref), date)
                member = gzip.compress(plain, 6, mtime=0)
                out.write(member)
                size += len(member)
                if size >= file_bytes:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        yield pd.DataFrame(done, columns=["name", "bytes"]).astype({"bytes": "i8"})

    files = sorted((r["name"], r["bytes"]) for r in decided(pages).mapInPandas(run, "name string, bytes long").collect())  # a row for each file
    fs, at = storage.filesystem(uri)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/files.json") as f:
        f.write(json.dumps([{"name": n, "bytes": b} for n, b in files]).encode())
    return uri


class Bad(Exception):
    """A failed check."""


Read = Callable[[int, int], bytes]


def _wrong(told: str, data: bytes) -> bool:
    """Whether a digest, in hex or base 32, is not that of the data; one of an unknown kind says nothing."""
    kind, _, value = told.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return False
    made = hashlib.new(kind, data).digest()
    return value.strip().lower() != made.hex() and value.strip().upper().rstrip("=") != base64.b32encode(made).decode().rstrip("=")


def parse(read: Read, at: int, size: int) -> tuple[dict, bytes, int]:
    """Header fields (lower case), payload and end of the record at ``at``, all checks passed."""
    n = _CHUNK
    while (stop := (head := read(at, min(n, size - at))).find(b"\r\n\r\n")) < 0:
        if not head.startswith(VERSION) or at + n >= size:
            raise Bad("no version line" if not head.startswith(VERSION) else "no end of the header")
        n *= 4
    if not head.startswith(VERSION):
        raise Bad("no version line")
    lines = head[:stop].decode(errors="replace").split("\r\n")[1:]
    for k in range(len(lines) - 1, 0, -1):  # a line that begins with white space goes on with the one before
        if lines[k][:1] in (" ", "\t"):
            lines[k - 1 : k + 1] = [f"{lines[k - 1]} {lines[k].strip()}"]
    if any(":" not in x for x in lines):
        raise Bad("a header line without a colon")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    if not fields.get("content-length", "").isdigit():
        raise Bad("no length")
    a = at + stop + 4
    b = a + int(fields["content-length"])
    if b + 4 > size:
        raise Bad("longer than what is there")
    block = read(a, b - a)
    if read(b, 4) != b"\r\n\r\n":
        raise Bad("no end mark")
    http = fields.get("content-type", "").startswith("application/http")
    payload = block
    if http:
        top, _, payload = block.partition(b"\r\n\r\n")
        fields |= {"http-" + k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in top.decode(errors="replace").split("\r\n")[1:] if ":" in x)}
    if _wrong(fields.get("warc-block-digest", ""), block):
        raise Bad("block digest")
    # a revisit has no payload, and a segment is not all of it
    if fields.get("warc-type") not in ("revisit", "continuation") and "warc-segment-number" not in fields and _wrong(fields.get("warc-payload-digest", ""), payload):
        raise Bad("payload digest")
    return fields, payload, b + 4


def _find(read: Read, at: int, size: int, members: bool = True) -> int:
    """Next place of a version line at the start of a line, or of a gzip member that begins with one; size if there is none."""
    while at < size:
        for m in START.finditer(read(at, min(_CHUNK + len(VERSION) - 1, size - at))):
            k = at + m.start()
            if m.start() < _CHUNK and (read(k - 1, 1) == b"\n" if m[0] == VERSION else members and _member(read, k, size, 64)[0].startswith(VERSION)):
                return k
        at += _CHUNK
    return size


def _region(read: Read, size: int) -> Iterator[tuple]:
    """Records and gaps of a member's bytes: ("record", start, end, fields, payload) and ("gap", start, end, reason)."""
    at = 0
    while at < size:
        try:
            fields, payload, end = parse(read, at, size)
            yield "record", at, end, fields, payload
        except Bad as e:
            end = _find(read, at + 1, size, members=False)
            yield "gap", at, end, str(e)
        at = end


def _member(read: Read, at: int, size: int, most: int | None = None) -> tuple[bytes, int, str]:
    """Bytes of the gzip member at ``at``, its end and what is wrong with it (empty: nothing). ``most``: stop after so many bytes."""
    machine, out, n = zlib.decompressobj(31), [], 0
    k = at
    while k < size and not machine.eof:
        chunk = read(k, min(_CHUNK, size - k))
        try:
            out.append(machine.decompress(chunk))
        except zlib.error as e:
            return b"".join(out), k, str(e)
        k += len(chunk)
        n += len(out[-1])
        if most and n >= most:
            break
    return b"".join(out), k - len(machine.unused_data), "" if machine.eof else "the member does not end"


def salvage(read: Read, size: int) -> Iterator[tuple]:
    """Records and gaps of an archive, compressed by record or not; places are those of the file."""
    at = 0
    while at < size:
        if read(at, len(MAGIC)) != MAGIC:
            try:
                fields, payload, end = parse(read, at, size)
                yield "record", at, end, fields, payload
            except Bad as e:
                end = _find(read, at + 1, size)
                yield "gap", at, end, str(e)
            at = end
            continue
        data, end, wrong = _member(read, at, size)
        inner = lambda a, n, data=data: data[a : a + n]
        if not wrong:
            for x in _region(inner, len(data)):
                yield (x[0], at, end, *x[3:])
        else:
            # whole records in front of the damage are kept
            for x in _region(inner, len(data)):
                if x[0] == "record":
                    yield (x[0], at, end, *x[3:])
            end = _find(read, at + 1, size)
            yield "gap", at, end, wrong
        at = end


def read(spark: SparkSession, uri: str, files: list[str] | None = None, with_payload: bool = False) -> DataFrame:
    """Records and gaps of the archives under ``uri`` (``files``: names; otherwise those that write() listed).

    kind (record or gap), file, start, end, reason (of gaps), and of records: type, record_id, refers_to, uri, payload_bytes,
    payload_digest (of the full payload, also for revisits), payload if asked for. payload_bytes of a foreign revisit that does not tell its length is null.
    """
    fs, at = storage.filesystem(uri)
    if files is None:
        with fs.open_input_stream(f"{at}/files.json") as f:
            files = [x["name"] for x in json.loads(f.read())]
    schema = "kind string, file string, start long, end long, reason string, type string, record_id string, refers_to string, uri string, payload_bytes long, payload_digest string, payload binary"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = storage.filesystem(uri)
        names = [f.strip() for f in schema.replace(" string", "").replace(" long", "").replace(" binary", "").split(",")]
        for b in batches:
            for name in b["name"]:
                out, held = [], 0
                with fs.open_input_file(f"{at}/{name}") as f:
                    for x in salvage(lambda a, n, f=f: f.read_at(n, a), f.size()):
                        if x[0] == "gap":
                            out.append((*x[:1], name, *x[1:4], *[None] * 7))
                            continue
                        _, start, end, fields, payload = x
                        kind = fields.get("warc-type")
                        length, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if kind == "revisit":
                            told = fields.get("http-content-length", "")
                            length, digest = int(told) if told.isdecimal() else None, fields.get("warc-payload-digest", "").removeprefix("sha256:")
                        out.append(("record", name, start, end, None, kind, fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), length, digest, payload if with_payload else None))
                        held += len(payload) if with_payload else 0
                        if len(out) >= 2000 or held > 1 << 25:
                            yield pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64"})
                            out, held = [], 0
                yield pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64"})

    listed = spark.createDataFrame([(k, n) for k, n in enumerate(files)], "k int, name string").repartitionByRange(len(files), "k").select("name")
    return listed.mapInPandas(run, schema)


def quarantine(records: DataFrame, uri: str) -> str:
    """Log the gaps of read()'s records as a table under ``uri``: file, start, end, reason, bytes; returns ``uri``."""
    records.filter("kind = 'gap'").select("file", "start", "end", "reason", (F.col("end") - F.col("start")).alias("bytes")).write.parquet(uri)
    return uri


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of write()'s records."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    found = records.filter("kind = 'record'")
    as_long = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return found.select(as_long("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), as_long("refers_to").alias("refers_to"))
