import random
import hashlib
import base64
import gzip

from junctura import storage
from junctura.llm import warc

HTML = "<p>" + "long enough to be a revisit ü " * 5


def pages(spark):
    rows = [(5, "http://a/1", HTML), (2, "http://a/ 2\n", HTML), (9, None, HTML), (3, "u", "short"), (4, "u", "short"), (1, "u", None), (7, "u", ""), (None, "u", HTML), (2, "u", HTML)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip(spark):
    uri = warc.write(pages(spark), storage.new_dir(spark, "w"), file_bytes=300)
    got = warc.page_records(warc.read(spark, uri)).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to or -1, r.payload_bytes) for r in got) == sorted(
        [(5, "revisit", 2, len(HTML.encode())), (2, "response", -1, len(HTML.encode())), (2, "response", -1, len(HTML.encode())), (9, "revisit", 2, len(HTML.encode())), (-1, "revisit", 2, len(HTML.encode()))]
        + [(i, "response", -1, n) for i, n in ((3, 5), (4, 5), (1, 0), (7, 0))]
    )
    texts = {r.record_id: bytes(r.payload) for r in warc.read(spark, uri, with_payload=True).collect() if r.type == "response"}
    assert texts["<urn:page:2>"] == HTML.encode() and texts["<urn:page:1>"] == b""
    assert warc.read(spark, warc.write(pages(spark).limit(0), storage.new_dir(spark, "w"))).count() == 0


def records(n):
    return [warc._record(i, "u", b"payload %d " % i * 40, __import__("hashlib").sha256(b"payload %d " % i * 40).hexdigest(), None, "d") for i in range(n)]


def found(data):
    out = list(warc.salvage(lambda a, n: data[a : a + n], len(data)))
    return [x[3]["warc-record-id"] for x in out if x[0] == "record"], [x[1:3] for x in out if x[0] == "gap"]


def test_salvage_of_members():
    members = [gzip.compress(r, mtime=0) for r in records(5)]
    assert found(b"".join(members)) == ([f"<urn:page:{i}>" for i in range(5)], [])
    broken = bytearray(b"".join(members))
    a = len(members[0]) + len(members[1])
    broken[a + 30 : a + 40] = b"\xff" * 10
    ids, gaps = found(bytes(broken))
    assert ids == [f"<urn:page:{i}>" for i in (0, 1, 3, 4)] and gaps == [(a, a + len(members[2]))]
    ids, gaps = found(b"junk" + b"".join(members)[:-9])
    assert ids[:4] == [f"<urn:page:{i}>" for i in range(4)] and gaps[0] == (0, 4) and gaps[-1][1] == sum(map(len, members)) - 5
    wrong = gzip.compress(records(1)[0].replace(b"payload 0", b"payload 1", 1), mtime=0)
    assert found(members[1] + wrong + members[2])[0] == ["<urn:page:1>", "<urn:page:2>"]


def test_salvage_of_plain_records():
    plain = records(4)
    data = b"".join(plain)
    a = len(plain[0])
    cut = data[: a + 5] + b"XX" + data[a + 7 :]
    assert found(cut)[0] == [f"<urn:page:{i}>" for i in (0, 2, 3)]
    assert found(data.replace(b"Content-Length: ", b"Content-Length: 9", 1))[0][-3:] == [f"<urn:page:{i}>" for i in (1, 2, 3)]
    assert found(b"") == ([], [])
    assert found(data[:-1]) == ([f"<urn:page:{i}>" for i in range(3)], [(sum(map(len, plain[:3])), len(data) - 1)])


def test_salvage_of_mixed_kinds():
    plain = records(5)
    body = gzip.compress(b"<p>a page " * 50, mtime=0)
    packed = warc._record(9, "u", body, __import__("hashlib").sha256(body).hexdigest(), None, "d")
    ids = [f"<urn:page:{i}>" for i in range(5)]
    assert found(packed + b"".join(plain)) == (["<urn:page:9>", *ids], [])
    assert found(b"x" + packed + b"".join(plain))[0] == ids
    members = [gzip.compress(r, mtime=0) for r in plain]
    lost = b"\xff" * 70_000
    assert found(lost + b"".join(members)) == (ids, [(0, 70_000)])
    damaged = plain[0][:-9] + b"".join(members[1:3]) + b"??\n" + b"".join(plain[3:])
    assert found(damaged)[0] == ids[1:]


def test_long_header():
    digest = __import__("hashlib").sha256(b"p").hexdigest()
    long = warc._record(1, "\x01" * 500_000, b"p", digest, None, "d")
    assert found(gzip.compress(long)) == (["<urn:page:1>"], []) and found(long + records(1)[0])[0] == ["<urn:page:1>", "<urn:page:0>"]


def record(payload, head=""):
    block = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + payload
    return f"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def found_in(data):
    return [x[0] for x in warc.salvage(lambda a, n: data[a : a + n], len(data))]


def test_plain_archive_with_a_compressed_payload_first():
    data = record(gzip.compress(b"one" * 100)) + record(b"two") + record(b"three")
    assert found_in(data) == ["record"] * 3


def test_first_64_kb_destroyed():
    noise = random.Random(1).randbytes(200_000).hex().encode()
    data = bytearray(b"".join(gzip.compress(record(x)) for x in (noise, b"two", b"three")))
    data[: 1 << 16] = bytes(1 << 16)
    assert found_in(bytes(data)) == ["gap", "record", "record"]


def test_folded_headers_and_other_digests():
    payload = b"some payload"
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert found_in(record(payload, "X-Note: begins\r\n  and goes on\r\n")) == ["record"]
    assert found_in(record(payload, f"WARC-Payload-Digest: sha1:{sha1}\r\n")) == ["record"]
    assert found_in(record(b"Some payload", f"WARC-Payload-Digest: sha1:{sha1}\r\n") + record(b"x")) == ["gap", "record"]
    assert found_in(record(payload, f"WARC-Block-Digest: md5:{'0' * 32}\r\n")) == ["gap"]
