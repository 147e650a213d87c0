"""Stable ids from hashes (FN15), and deterministic JSON (FN37)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, functions as F

ID_LENGTH = 24


def hashed(prefix: str, value: Column, bits: int = 128) -> Column:
    """Prefix and the first 24 hex digits: md5 for 128 bits, sha1 for 160, sha256 for 256."""
    digest = {128: F.md5, 160: F.sha1}[bits](value) if bits < 256 else F.sha2(value, 256)
    return F.concat(F.lit(prefix), F.substring(digest, 1, ID_LENGTH))


def station_id(kind: str, *parts: Column) -> Column:
    """Id of a station group: ``kind`` is hard, geo or name."""
    return hashed("gstn_", F.concat_ws("|", F.lit(kind), *(p.cast("string") for p in parts)))


def cluster_key(members: Column) -> Column:
    """Hash of the sorted members of a cluster."""
    return F.md5(F.array_join(F.array_sort(members), ","))


def canonical_json(value: object) -> str:
    """Keys sorted, no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def json_sha256(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()
