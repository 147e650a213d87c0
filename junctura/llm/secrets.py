"""Secret scans: fixed patterns, and novelty of what stands in sensitive places, measured by dictionary-primed zstandard.

The patterns (assign, access, hex) are always reported. The method adds spans: a run of secret-like characters with a
sensitive word close before it, in code or prose, is compressed with a dictionary made of a stock of
identifiers and of the text around it. Its marginal bytes, what it adds to the compressed surroundings, tell whether it says anything that
the surroundings and ordinary names don't: a string that stays incompressible is reported as ``novel``. Runs are maximal, and each is measured and reported once,
whole, but for a sensitive name in its head (``client_secret=``).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A maximal run is long enough exactly where this matches: both classes hold all characters that can start a match.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Words that make what follows them sensitive, as fixed values.
SENSITIVE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "auth", "bearer", "credential", "private", "signature", "access_key", "client_id", "webhook", "session")
CONTEXT = re.compile(r"(?ai)" + "|".join(map(re.escape, SENSITIVE)))
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~$!@#%^&*.-]{12,}")
#: Words and camel-case names. A plain word costs the compressor as many bytes as random letters do, so it takes more of them.
WORDS = re.compile(r"(?:[^A-Za-z0-9]*(?:[A-Z]?[a-z]{2,}|[A-Z]{3,}))+[^A-Za-z0-9]*")
#: Names that code is full of: a stock for the compressor, as fixed values.
IDENTIFIERS = (
    "abstract accept account action address append application argument array attribute authorization background boolean buffer builder button bytes callback "
    "channel character class client collection column command comment component config configuration connection constant container content context controller "
    "count create cursor custom data database date debug decode default delete description destination device dictionary directory display document domain "
    "download element email enable encode endpoint environment error event example exception execute export expression extension factory false field file filter "
    "final float format function generate global group handler hash header height hidden host http https identifier image implement import index information "
    "initialize input insert instance integer interface internal iterator javascript kernel label language latitude layout length level library license line "
    "link list listener local location logger login longitude manager margin match message metadata method middleware model module mutable name namespace "
    "network node notification null number object offset operation option order output override package padding page parameter parent parse password path "
    "pattern payload permission placeholder platform plugin pointer policy position prefix private process production profile progress project property protected "
    "protocol provider public query queue random range reader receive record redirect reference register release remote render replace request require reset "
    "resource response result return route schema scope screen script search secret section select sequence server service session setting signature size source "
    "stack start state static status stream string struct style submit subscribe success suffix switch system table target template test text thread timeout "
    "timestamp title token transaction transform true type undefined unique update upload user username utility validate value variable vector version view visible "
    "volume warning webhook width window worker writer your_api_key_here your-secret-token changeme example_password xxxxxxxxxxxxxxxx 0123456789abcdef "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ process.env. os.environ[ System.getenv( config.get( .example.com https://www. localhost:8080"
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the fixed patterns; places are code points."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


class Novelty:
    def __init__(self, around: int = 400, reach: int = 48, bits: float = 4.2, least: int = 12, least_words: int = 24):
        self.around, self.reach, self.bits, self.least, self.least_words = around, reach, bits, least, least_words
        self.stock = IDENTIFIERS.encode()

    def marginal_bytes(self, candidate: str, before: str, after: str) -> int:
        """Bytes that the candidate adds to its compressed surroundings, given the dictionary."""
        near = (before + after).encode(errors="replace")
        primed = zstandard.ZstdCompressionDict(self.stock + near, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False)
        tail = before[-64:].encode(errors="replace")
        return len(compressor.compress(tail + candidate.encode(errors="replace"))) - len(compressor.compress(tail))

    def spans(self, text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Candidates shortly after a sensitive word that base spans don't cover and that do not compress."""
        low = text.lower()
        if not any(k in low for k in SENSITIVE):
            return []
        out = []
        words = [(m.start(), m.end()) for m in CONTEXT.finditer(text)]
        starts = [x for x, _ in words]
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            k = bisect_left(starts, a)
            # words hold only characters of runs, so one that starts before a run ends before it
            sensitive = k > 0 and a - words[k - 1][1] <= self.reach
            # a name in the run's head, as in client_secret=...
            inner = next((y for x, y in words[k : bisect_left(starts, a + self.reach)] if b - y >= self.least and not text[y].isalnum()), None)
            if inner is not None and (not sensitive or text[inner] == "="):
                a = inner
            elif not sensitive:
                continue
            # what fixed patterns leave of it
            if b - a - sum(max(0, min(b, y) - max(a, x)) for x, y in merged(known)) < self.least:
                continue
            got = self.marginal_bytes(text[a:b], text[max(0, a - self.around) : a], text[b : b + self.around])
            if 8 * got >= self.bits * (b - a) and got >= (self.least_words if WORDS.fullmatch(text, a, b) else self.least):
                out.append((a, b, "novel"))
        return out


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """start, end of what spans cover, without overlaps."""
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan(docs: DataFrame, **novelty) -> DataFrame:
    """doc_id and what the scan finds in documents (doc_id, text; other columns are ignored), a row per row.

    n_assign, n_access, n_hex, n_novel; base_spans and spans, as ``kind:start:end`` by start, then kind, comma-joined; base_sha256 of
    the former. Places are code points, ends exclusive. Null and empty texts have none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        method = Novelty(**novelty)
        for b in batches:
            rows = []
            for t in b["text"]:
                t = t or ""
                base = base_spans(t)
                more = method.spans(t, base)
                n = [sum(s[2] == k for s in base) for k in KINDS[:3]]
                text = listed(base)
                rows.append((*n, len(more), text, hashlib.sha256(text.encode()).hexdigest(), listed(base + more)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_novel", "base_spans", "base_sha256", "spans"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy(dtype=object))
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_spans string, base_sha256 string, spans string")
