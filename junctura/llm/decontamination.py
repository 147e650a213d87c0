"""Benchmark decontamination by a distributed positional inverted index.

The index holds, for each term that a test phrase is looked up by, the training documents and the term's places in them.
A phrase starts from the list of its rarest term; that list is intersected with those of its next rarest terms, each list
moved back by the term's place in the phrase. What is left is compared with the text and so exact. Terms'
counts come from all of the training data. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import storage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a side that is broadcast at most (their size is bounded by it: a phrase is short); above it, Spark's own joins take over.
BROADCAST_ROWS = 200_000
#: Terms that a phrase is looked up by, the rarest first.
ANCHORS = 3


def words(text: Column) -> Column:
    """Words of a text: runs of 0-9, a-z and all characters above U+007F, after lower-casing A-Z."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _rows(docs: DataFrame) -> DataFrame:
    """Rows by doc_id and a hash of the text: rows that repeat a doc_id with other texts stay apart, equal rows share a result."""
    t = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(t).alias("h"), words(t).alias("words"))


def phrases(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """item_id, phrase (its words, joined by blanks): each run of n words of an item, or the whole of a shorter one. Items without words have none."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))).alias("i"))
    return starts.select("item_id", F.array_join(F.slice("w", F.col("i"), n), " ").alias("phrase")).distinct()


def anchors(tokens: DataFrame, phrase: DataFrame, most: int = ANCHORS) -> DataFrame:
    """phrase, k (1: rarest), term, place (of the term in the phrase), for phrases whose terms all occur in ``tokens`` (term)."""
    terms = phrase.select("phrase", F.posexplode(F.split("phrase", " ")).alias("place", "term"))
    vocabulary = terms.select("term").distinct()
    counts = tokens.join(_small(vocabulary), "term").groupBy("term").count()
    counted = terms.join(counts, "term", "left")
    by_phrase = Window.partitionBy("phrase")
    ranked = counted.select("*", F.min(F.coalesce("count", F.lit(0))).over(by_phrase).alias("least"), F.row_number().over(by_phrase.orderBy("count", "term", "place")).alias("k"))
    return ranked.filter((F.col("least") > 0) & (F.col("k") <= most)).select("phrase", "k", "term", "place")


def index(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The inverted index over some terms: term, d, h, places (ascending). A list is split by document, so no term is one group."""
    tokens = rows.select("d", "h", F.posexplode("words").alias("place", "term"))
    return tokens.join(_small(terms), "term").groupBy("term", "d", "h").agg(F.sort_array(F.collect_set("place")).alias("places"))


def candidates(postings: DataFrame, anchored: DataFrame, slop: int = 0) -> DataFrame:
    """phrase, d, h, starts: where the lists of all the phrase's anchors meet, at most ``slop`` words from their places."""
    first = anchored.filter("k = 1").drop("k")
    found = postings.join(_small(first), "term").select("phrase", "d", "h", F.transform("places", lambda p: p - F.col("place")).alias("starts"))
    if not slop:
        found = found.withColumn("starts", F.filter("starts", lambda s: s >= 0)).filter("size(starts) > 0")
    for k in range(2, ANCHORS + 1):
        # phrases of fewer terms pass: their last lists are those that have been met already
        nth = anchored.filter(F.col("k") == k).select("phrase", F.col("term").alias("next"), F.col("place").alias("at"))
        open_, lists = found.join(_small(nth), "phrase", "left"), postings.select(F.col("term").alias("next"), "d", "h", "places")
        met = open_.join(lists, ["next", "d", "h"], "left")
        near = F.filter("starts", lambda s: F.exists("places", lambda p: F.abs(p - F.col("at") - s) <= slop)) if slop else F.array_intersect("starts", F.transform("places", lambda p: p - F.col("at")))
        found = met.select("phrase", "d", "h", F.when(F.col("next").isNull(), F.col("starts")).otherwise(near).alias("starts")).filter("size(starts) > 0")
    return found


def _prepared(docs: DataFrame, benchmark: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = _rows(docs)
    of_items = storage.stored(phrases(benchmark, n), "phrases")
    anchored = storage.stored(anchors(rows.select(F.explode("words").alias("term")), of_items.select("phrase").distinct()), "anchors")
    postings = storage.stored(index(rows, anchored.select("term").distinct()), "postings")
    return rows, of_items, anchored, postings


def exact_matches(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Phrase matches of documents (doc_id, text) and benchmark items (item_id, text); other columns are ignored.

    First: a row per document: d, h (see _rows), n_words, hits (array of start and phrase). Second: item_id and phrase. Null and
    empty texts have no words; an empty table gives no hits.
    """
    rows, of_items, anchored, postings = _prepared(docs, benchmark, n)
    found = storage.stored(candidates(postings, anchored).groupBy("d", "h").agg(F.collect_list(F.struct("phrase", "starts")).alias("found")), "candidates")
    pairs = F.flatten(F.transform("found", lambda f: F.transform(f["starts"], lambda s: F.struct(s.alias("start"), f["phrase"].alias("phrase")))))
    here = lambda c: F.array_join(F.slice("words", c["start"] + 1, F.size(F.split(c["phrase"], " "))), " ") == c["phrase"]
    joined = rows.join(_small(found), ["d", "h"], "left")
    hits = F.when(F.col("found").isNull(), F.array().cast("array<struct<start:int,phrase:string>>")).otherwise(F.filter(pairs, here))
    return joined.select("d", "h", F.size("words").cast("long").alias("n_words"), hits.alias("hits")), of_items


def proximity_matches(docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 2) -> DataFrame:
    """item_id, doc_id, starts: where a phrase's rarest terms all stand at most ``slop`` words from their places, words between them changed or not."""
    _, of_items, anchored, postings = _prepared(docs, benchmark, n)
    found = candidates(postings, anchored, slop).join(of_items, "phrase")
    return found.select("item_id", F.when(F.col("d") != -(1 << 63), F.col("d")).alias("doc_id"), F.explode("starts").alias("start")).distinct().groupBy("item_id", "doc_id").agg(F.sort_array(F.collect_list("start")).alias("starts"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """d, h, n_words, n_hit (words inside any phrase match), n_items, items_sha256, contaminated; a row per row of docs."""
    matched, of_items = exact_matches(docs, benchmark, n)
    ends = F.sort_array(F.transform("hits", lambda x: F.struct(x["start"].alias("a"), (x["start"] + F.size(F.split(x["phrase"], " "))).alias("b"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["b"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(a["end"], x["a"]))).alias("n"))
    n_hit = F.aggregate(ends, start, step, lambda a: a["n"])
    docs_hit = storage.stored(matched.select("d", "h", "n_words", n_hit.alias("n_hit"), F.array_distinct(F.transform("hits", lambda x: x["phrase"])).alias("phrases")), "matches")
    by_doc = docs_hit.filter("n_hit > 0").dropDuplicates(["d", "h"]).select("d", "h", F.explode("phrases").alias("phrase"))
    items = by_doc.join(_small(of_items), "phrase").select("d", "h", F.col("item_id").cast("string").alias("item")).distinct().groupBy("d", "h").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = docs_hit.join(items, ["d", "h"], "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("d", "h", "n_words", "n_hit", F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """All columns of docs; only rows in which no phrase of a benchmark item stands."""
    matched, _ = exact_matches(docs, benchmark, n)
    hit = storage.stored(matched.filter("size(hits) > 0").select("d", "h").distinct(), "contaminated")
    d, h = storage.free_name("_d", docs), storage.free_name("_h", docs)
    keyed = docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn(h, F.xxhash64(F.col("text").cast("string")))
    return keyed.join(_small(hit.select(F.col("d").alias(d), F.col("h").alias(h))), [d, h], "left_anti").select(*(f"`{c}`" for c in docs.columns))
