"""Chunks of documents that ask each other about names (hashes of parts of their texts).

A corpus is written once as a table of chunks of some megabytes, bucketed by chunk, so that answers come to a chunk without moving texts.
In a round each chunk sorts its names, sends each once, dealt by ranges of the name into buckets; a task that has a bucket sees what all
chunks say of its names, and tells each chunk the places of those that it should know of. A name that is in all documents is one entry a
chunk. The chunk works its list out again in the next round, so places are enough for an answer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .. import storage

#: Bytes of text of a chunk; a longer document is a chunk of its own. Larger corpora are served by larger chunks.
CHUNK = 8 << 20
CHUNKS = "chunk long, ids array<long>, langs array<string>, offsets binary, data binary"
ASKS = "bucket int, chunk long, base long, a binary, b binary, c binary"
ANSWERS = "chunk long, round int, places binary, marks binary"
_P = np.uint64(0x9E3779B97F4A7C15)


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, k, held, n = TaskContext.get().partitionId(), 0, [], 0

    def chunk() -> pa.RecordBatch:
        texts = pa.concat_arrays([h[2] for h in held])
        data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], "i4"), texts), pa.scalar(b"\n", pa.binary()))[0].as_py()
        starts = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("i8") + 1)])
        ids, langs = (pa.concat_arrays([h[j] for h in held]) for j in (0, 1))
        return pa.RecordBatch.from_arrays(
            [pa.array([task << 32 | k], "i8"), pa.ListArray.from_arrays(pa.array([0, len(ids)], "i4"), ids), pa.ListArray.from_arrays(pa.array([0, len(langs)], "i4"), langs), pa.array([starts.tobytes()]), pa.array([data], pa.binary())],
            ["chunk", "ids", "langs", "offsets", "data"],
        )

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        at = 0
        for i, s in enumerate(sizes.tolist()):
            if n and n + s > size:
                held.append([batch.column(c).slice(at, i - at) for c in ("doc_id", "lang")] + [texts.slice(at, i - at)])
                yield chunk()
                k, held, n, at = k + 1, [], 0, i
            n += s + 1
        held.append([batch.column(c).slice(at) for c in ("doc_id", "lang")] + [texts.slice(at)])
    if n:
        yield chunk()


class Corpus:
    """Chunks of a table of documents, and the rounds so far. Use it inside storage.tables(); close() forgets the table's name."""

    def __init__(self, docs: DataFrame, held: storage.Tables, chunk: int | None = None):
        size = chunk or CHUNK
        self.spark, self.held, self.name = docs.sparkSession, held, f"junctura_chunks_{uuid.uuid4().hex}"
        lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
        packed = rows.mapInArrow(lambda b: _packed(b, size), CHUNKS)
        packed.write.bucketBy(storage.shuffle_partitions(self.spark), "chunk").format("parquet").option("compression", "zstd").option("path", held.dir("chunks")).saveAsTable(self.name)
        self.chunks = self.spark.table(self.name)
        self.buckets = max(1, 4 * self.chunks.select("chunk").count())
        self.answers: DataFrame | None = None

    def close(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")

    def visit(self, f: Callable, schema: str) -> DataFrame:
        """f(chunk, answers by round) of all chunks; it gives record batches. answers: pairs of places and marks."""
        if self.answers is None:

            def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in range(batch.num_rows):
                        yield from f(Chunk(batch, row), {})

            return self.chunks.mapInArrow(alone, schema)
        to = pa.schema(_fields(schema))

        def both(chunk: pa.Table, answers: pa.Table) -> pa.Table:
            found: dict[int, list] = {}
            for k, places, marks in zip(answers["round"].to_pylist(), answers["places"].to_pylist(), answers["marks"].to_pylist(), strict=True):
                found.setdefault(k, []).append((np.frombuffer(places, "<u4").astype("i8"), np.frombuffer(marks, "u1")))
            got = {k: (np.concatenate([p for p, _ in v]), np.concatenate([m for _, m in v])) for k, v in found.items()}
            given = [b for batch in chunk.to_batches() for row in range(batch.num_rows) for b in f(Chunk(batch, row), got)]
            return pa.Table.from_batches(given) if given else to.empty_table()

        return self.chunks.groupBy("chunk").cogroup(self.answers.groupBy("chunk")).applyInArrow(both, schema)

    def ask(self, asks: Callable, answer: Callable) -> None:
        """A round: asks(chunk, answers) gives deal()'s batches, answer(sorted asks of a bucket) the places to tell; see Heard."""
        k = 0 if self.answers is None else self.rounds

        def heard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from answer(Heard(list(batches)), k)

        now = self.held.stored(self.visit(asks, ASKS).groupBy("bucket").applyInArrow(heard, ANSWERS), f"answers-{k}")
        self.answers = now if self.answers is None else self.answers.unionByName(now)
        self.rounds = k + 1
        # nothing refers to the round's plan any more
        self.held.free()


def _fields(schema: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)]


class Chunk:
    """A row of the table of chunks."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.id = batch.column("chunk")[row].as_py()
        self.ids, self.langs = (batch.column(c)[row].values for c in ("ids", "langs"))
        self.starts = np.frombuffer(batch.column("offsets")[row].as_py(), "<i8")
        self.data = batch.column("data")[row].as_py()

    @property
    def ends(self) -> np.ndarray:
        """Ends of the documents; a byte that is none of theirs follows each."""
        return self.starts[1:] - 1

    def keys(self) -> np.ndarray:
        """Ids as numbers; null stands before all others."""
        return self.ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def deal(chunk: int, names: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that has one of the sorted names; columns go with them, at most three."""
    bounds = np.searchsorted(bucket_of(names, buckets), np.arange(buckets + 1, dtype="u8"))
    full = np.flatnonzero(np.diff(bounds))
    parts = [pa.array([c[bounds[b] : bounds[b + 1]].tobytes() for b in full.tolist()], pa.binary()) for c in columns]
    parts += [pa.nulls(len(full), pa.binary())] * (3 - len(parts))
    yield pa.RecordBatch.from_arrays([pa.array(full, "i4"), pa.array(np.full(len(full), chunk), "i8"), pa.array(bounds[full], "i8"), *parts], ["bucket", "chunk", "base", "a", "b", "c"])


class Heard:
    """What chunks ask of one bucket."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.batches = batches

    def column(self, name: str, kind: str) -> np.ndarray:
        parts = [np.frombuffer(v.as_buffer(), kind) for b in self.batches for v in b.column(name)]
        return np.concatenate(parts) if parts else np.zeros(0, kind)

    def rows(self, width: int) -> Iterator[tuple[int, int, int]]:
        """Chunk, first place and number of entries of each row; column a has ``width`` bytes an entry."""
        for b in self.batches:
            for chunk, base, a in zip(b.column("chunk").to_pylist(), b.column("base").to_pylist(), b.column("a"), strict=True):
                yield chunk, base, a.as_buffer().size // width

    def tell(self, k: int, width: int, told: np.ndarray, marks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Answers: the places of the entries that are told, and their marks."""
        out, at = [], 0
        for chunk, base, n in self.rows(width):
            here = np.flatnonzero(told[at : at + n])
            if len(here):
                out.append((chunk, k, (here + base).astype("<u4").tobytes(), (marks[at : at + n][here] if marks is not None else np.zeros(0)).astype("u1").tobytes()))
            at += n
        names = ("chunk", "round", "places", "marks")
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(kinds)], list(names))


def groups(*sorted_keys: np.ndarray) -> np.ndarray:
    """First places of runs of equal keys."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name of pairs of names."""
    with np.errstate(over="ignore"):
        x = a >> np.uint64(29)
        x ^= a
        x *= _P
        x += b
        y = x >> np.uint64(32)
        x ^= y
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        np.right_shift(x, np.uint64(31), out=y)
        x ^= y
    return x
