"""Line dedup by an exact set-similarity join.

A line is the set of its words (runs without ASCII white space). It goes if an earlier line, in (doc_id, line)
order and whether that stays or not, has the same set or one of Jaccard similarity 0.8 or more; so what happens to a line does not depend on
an order of work. Lines without words stay.

Lines of equal bytes (a 128-bit BLAKE2 digest) are one. Others meet by set_join: prefixes of rarest tokens, length and positional filters, parity bounds.
Proposals are verified on the words themselves; lines whose proposals all fail ask the lists that had more for the next ones, sixteen times as
many, until none is left. So large groups of near copies give a few pairs per line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import storage
from . import hashing, set_join
from .set_join import small

#: Bits of a token that lists keep.
TOKEN_BITS = 31


def lines_of(docs: DataFrame, cells: str) -> DataFrame:
    """The lines with words as set_join's items; tokens are 31-bit hashes. Lines that stand earlier in the same task's rows have empty prefixes."""
    bits = TOKEN_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades = set_join.rarity(cells)
        seen: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            ids = batch["d"].to_numpy()
            for buf, row, begins, base in hashing.pieces(batch["text"]):
                h, starts = hashing.words(buf)
                feeds = np.flatnonzero(np.frombuffer(buf, "u1") == 10)
                line, first, texts = np.searchsorted(feeds, starts), np.searchsorted(feeds, begins), buf.split(b"\n")
                cut = 0
                while cut < len(h):
                    end = int(np.searchsorted(line, line[cut] + (1 << 17)))
                    number, n, *rest = set_join.sets(h[cut:end], line[cut:end], grades, bits)
                    cut = end
                    of = np.searchsorted(first, number, side="right") - 1
                    digests = [hashlib.blake2b(texts[k], digest_size=16).digest() for k in number.tolist()]
                    d, number = ids[row + of], number - first[of] + base
                    fresh = np.ones(len(d), bool)
                    for k, x in enumerate(zip(digests, d.tolist(), number.tolist())):
                        if (before := seen.get(x[0])) is None or x[1:] < before:
                            seen[x[0]] = x[1:]
                        else:
                            fresh[k] = False
                    if len(seen) > 100_000:
                        seen.clear()
                    t = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    cols = {"d": pa.array(d), "line": pa.array(number.astype("i4")), "n": pa.array(n.astype("i4")), "t": pa.array(t[:, 0].copy()), "t2": pa.array(t[:, 1].copy())}
                    yield pa.RecordBatch.from_pydict(cols | set_join.item_columns(fresh, n, *rest))

    return docs.select("d", "text").mapInArrow(run, set_join.ITEM)


def _with_lines(body):
    """body(lines of text), the text split once per row and not once per use."""
    return F.get(F.transform(F.array(F.split("text", "\n")), body), F.lit(0))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """d, line, words (distinct) of the wanted lines (d, line)."""
    by_doc = wanted.groupBy("d").agg(F.collect_set("line").alias("numbers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, line, words, size = [], [], [], 0
            for doc, text, numbers in zip(b["d"].to_pylist(), b["text"].cast(pa.large_binary()), b["numbers"].to_pylist()):
                lines = text.as_py().split(b"\n")
                for k in numbers:
                    d.append(doc), line.append(k), words.append(list(set(lines[k].split())))
                    size += len(words[-1])
                    if size > 200_000:
                        yield pa.RecordBatch.from_pydict({"d": pa.array(d, "i8"), "line": pa.array(line, "i4"), "words": pa.array(words, pa.list_(pa.string()))})
                        d, line, words, size = [], [], [], 0
            if d:
                yield pa.RecordBatch.from_pydict({"d": pa.array(d, "i8"), "line": pa.array(line, "i4"), "words": pa.array(words, pa.list_(pa.string()))})

    return docs.join(small(by_doc, 4, F.size("numbers")), "d").select("d", "text", "numbers").mapInArrow(run, "d long, line int, words array<string>")


def _verified(docs: DataFrame, pairs: DataFrame, tmp: storage.Tables) -> DataFrame:
    """xd, xl of the pairs whose sets are similar enough."""
    with storage.tables(docs.sparkSession) as inner:
        pairs = inner.stored(pairs, "pairs")
        ends = pairs.select(F.col("xd").alias("d"), F.col("xl").alias("line")).unionByName(pairs.select(F.col("yd").alias("d"), F.col("yl").alias("line"))).distinct()
        sets = inner.stored(_sets(docs, ends), "line-sets")
        x = sets.select(F.col("d").alias("xd"), F.col("line").alias("xl"), F.col("words").alias("xt"))
        y = sets.select(F.col("d").alias("yd"), F.col("line").alias("yl"), F.col("words").alias("yt"))
        both = F.size(F.array_intersect("xt", "yt"))
        p, q = set_join.SIMILARITY
        met = pairs.join(x, ["xd", "xl"]).join(y, ["yd", "yl"])
        return tmp.stored(met.filter(both * q >= (F.size("xt") + F.size("yt") - both) * p).select("xd", "xl").distinct(), "similar")


def similar_sets(docs: DataFrame, lines: DataFrame, tmp: storage.Tables) -> DataFrame:
    """d, line of lines that an earlier line is similar to. lines: as lines_of() gives them; docs: d, text."""
    lists, matched, wanted, skip, take = set_join.Lists(lines, tmp), None, None, 0, set_join.PROPOSALS
    while True:
        found = tmp.stored(lists.first(take) if wanted is None else lists.again(wanted, tmp, skip, take), "proposals")
        now = _verified(docs, found.filter("yl >= 0").select("xd", "xl", "yd", "yl").distinct(), tmp)
        matched = now if matched is None else matched.unionByName(now)
        more = found.filter("yl < 0").select("token", F.col("xd").alias("d"), F.col("xl").alias("line")).distinct()
        wanted = tmp.stored(more.join(small(matched.select(F.col("xd").alias("d"), F.col("xl").alias("line"))), ["d", "line"], "left_anti"), "asking")
        if not wanted.limit(1).count():
            return matched.select(F.col("xd").alias("d"), F.col("xl").alias("line"))
        skip, take = skip + take, 16 * take


def removed_lines(docs: DataFrame) -> DataFrame:
    """d and numbers (array, from 0) of the lines that go. docs: d, text, both without nulls, d unique."""
    with storage.tables(docs.sparkSession) as tmp:
        lines = tmp.stored(lines_of(docs, set_join.cell_counts(docs, tmp.dir("cells"))), "lines")
        # (d, line) as one number, as a minimum of numbers needs no sort
        at = F.col("d").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line")
        copied = lines.groupBy("t", "t2").agg(F.min(at).alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("t", "t2", "first")
        similar = tmp.stored(similar_sets(docs, lines, tmp).distinct(), "similar-lines")
        near = lines.join(small(similar), ["d", "line"], "left_semi").select("t", "t2").distinct().withColumn("near", F.lit(True))
        touched = tmp.stored(copied.join(near, ["t", "t2"], "full"), "touched")
        gone = lines.select("d", "line", "t", "t2").join(small(touched), ["t", "t2"]).filter((F.col("near")) | (at != F.col("first")))
        return storage.stored(gone.groupBy("d").agg(F.sort_array(F.collect_list("line")).alias("numbers")), "gone")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of docs, text without the lines that go, and a struct ``lines``: n_lines, n_removed (an existing column of that name is replaced).

    Earlier means smaller (doc_id, text), then line; null doc_ids come first, and rows that repeat doc_id and text follow each
    other in any order. Null texts stay null and have no lines. Texts are split at line feeds; a text that loses
    all its lines is empty. An empty table stays empty. Of a long text a task holds its bytes and the hashes of some lines, at least one line whole.
    """
    key = storage.free_name("_number", docs)
    numbered = storage.numbered(docs.drop("lines"), key)
    gone = removed_lines(numbered.filter("text is not null").select(F.col(key).alias("d"), F.col("text").cast("string").alias("text")))
    numbers = storage.free_name("_numbers", docs)
    joined = numbered.join(small(gone.select(F.col("d").alias(key), F.col("numbers").alias(numbers)), 4, F.size(numbers)), key, "left")
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(numbers))
    rest = _with_lines(lambda lines: F.array_join(F.transform(kept(lines), lambda k: F.get(lines, k)), "\n"))
    n = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    counts = F.struct(n.alias("n_lines"), F.when(F.col(numbers).isNull(), 0).otherwise(F.size(numbers)).cast("long").alias("n_removed"))
    text = F.when(F.col(numbers).isNull(), F.col("text")).otherwise(rest)
    return joined.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "lines"), counts.alias("lines"))
