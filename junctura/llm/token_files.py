"""Token-ID / binary output: flat unsigned integers and 64-bit document offsets, made for memory mapping.

A dataset is a folder of parts. ``<part>.bin`` holds the ids of the part's documents one after another, as
little-endian unsigned 16-bit integers where the vocabulary fits, else 32-bit. ``<part>.idx`` holds: 8 bytes
``JNTOKID1``, the id width and the number of documents n (both u64), n + 1 offsets into the part (u64, in
tokens), n doc_ids (i64), n bytes that are 1 where the doc_id is null. ``dataset.json`` lists the parts in order, with
each part's base: the tokens of all parts before it, a prefix sum over the parts' totals. Parts hold
ascending ranges of doc_id, so base + offset is a document's place in the whole.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import storage
from . import tokens

MAGIC = b"JNTOKID1"


class _PartWriter:
    """One part; ids go to the file as they come, only offsets and doc_ids stay in memory."""

    def __init__(self, uri: str, width: int):
        self.name, self.width = uuid.uuid4().hex, width
        self.fs, path = storage.filesystem(uri)
        self.fs.create_dir(path, recursive=True)
        self.base = f"{path}/{self.name}"
        self.out = self.fs.open_output_stream(f"{self.base}.bin")
        self.ends, self.ids, self.nulls, self.total = [0], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
        self.total += len(ids) // 4
        self.ends.append(self.total)
        self.ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)

    def close(self) -> None:
        self.out.close()
        with self.fs.open_output_stream(f"{self.base}.idx") as f:
            f.write(MAGIC + np.array([self.width, len(self.ids)], "<u8").tobytes() + np.array(self.ends, "<u8").tobytes())
            f.write(np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes())


def write(docs: DataFrame, uri: str, tokenizer: str | None = None, end_id: int | None = tokens.END_ID, parts: int | None = None) -> str:
    """Write documents (doc_id, text; other columns are ignored) as a dataset under ``uri``; returns ``uri``.

    Null texts count as empty: such a document has the end id alone. Rows that repeat a doc_id are all written, ordered by
    text; null doc_ids come first. An empty table gives a dataset without parts. Files of attempts that failed
    carry names of their own and are in no list.
    """
    spark, path = docs.sparkSession, tokenizer or tokens.default_tokenizer()
    width = 2 if tokens.encoder(path).size <= 1 << 16 else 4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = None
        for b in batches:
            for doc_id, null, ids in zip(b["doc_id"].fillna(0).astype("int64").tolist(), b["doc_id"].isna().tolist(), tokens.encoded(path, b["text"], end_id)):
                part = part or _PartWriter(uri, width)
                part.add(None if null else doc_id, ids)
        if part:
            part.close()
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "name": [part.name], "docs": [len(part.ids)], "tokens": [part.total]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(parts or storage.shuffle_partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    found = sorted((r.part, r.name, r.docs, r.tokens) for r in ordered.mapInPandas(run, "part int, name string, docs long, tokens long").collect())  # one row for each part
    bases = np.concatenate([[0], np.cumsum([r[3] for r in found], dtype="u8")]).astype(object)
    fs, at = storage.filesystem(uri)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/dataset.json") as f:
        f.write(json.dumps({"width": width, "parts": [{"name": r[1], "docs": r[2], "tokens": r[3], "base": int(b)} for r, b in zip(found, bases)]}).encode())
    return uri


def parts_of(uri: str) -> dict:
    fs, at = storage.filesystem(uri)
    with fs.open_input_stream(f"{at}/dataset.json") as f:
        return json.loads(f.read())


class Part:
    """Reads a part; files of a local or mounted folder are memory-mapped."""

    def __init__(self, uri: str, name: str):
        self.fs, at = storage.filesystem(uri)
        with self.fs.open_input_stream(f"{at}/{name}.idx") as f:
            if f.read(8) != MAGIC:
                raise ValueError(f"{name}.idx is no token index")
            width, n = np.frombuffer(f.read(16), "<u8").tolist()
            self.offsets = np.frombuffer(f.read(8 * (n + 1)), "<u8")
            self.doc_ids = np.frombuffer(f.read(8 * n), "<i8")
            self.nulls = np.frombuffer(f.read(n), "u1").astype(bool)
        self.dtype = np.dtype(f"<u{width}")
        if urlparse(uri).scheme in ("", "file"):
            self.map, self.file = np.memmap(f"{at}/{name}.bin", self.dtype, "r"), None
        else:
            self.map, self.file = None, self.fs.open_input_file(f"{at}/{name}.bin")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        if self.map is not None:
            return self.map[a:b]
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((b - a) * w, a * w), self.dtype)


def read(spark: SparkSession, uri: str, digest_only: bool = False) -> DataFrame:
    """One row per document of the dataset: doc_id, start, n_tokens, ids_crc32 and, unless ``digest_only``, ids."""
    meta = parts_of(uri)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>")
    listed = [(k, p["name"], p["base"]) for k, p in enumerate(meta["parts"])]
    if not listed:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, base in zip(b["name"], b["base"]):
                part = Part(uri, name)
                for a in range(0, len(part), 2000):
                    ks = range(a, min(a + 2000, len(part)))
                    ids = [part.ids(k) for k in ks]
                    out = pd.DataFrame(
                        {
                            "doc_id": pd.array(np.where(part.nulls[a : ks.stop], 0, part.doc_ids[a : ks.stop]), "Int64"),
                            "start": part.offsets[a : ks.stop].astype("i8") + base,
                            "n_tokens": [len(x) for x in ids],
                            "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                        }
                    )
                    out.loc[part.nulls[a : ks.stop], "doc_id"] = pd.NA
                    if not digest_only:
                        out["ids"] = [x.astype("i8") for x in ids]
                    yield out

    return spark.createDataFrame(listed, "part int, name string, base long").repartitionByRange(len(listed), "part").mapInPandas(run, schema)
