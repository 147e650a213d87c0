"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents, n_chars
brought up to the text that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from junctura.deploy import ship
from junctura import storage
from junctura.llm import decontamination, line_dedup, packing, quality, shingle_join

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: For near-duplicates of documents: shingles of five words, of which two documents share a Jaccard similarity of 0.8 or more.
SHINGLE = 5


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    ship(spark)
    return _documents(quality.passed(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one is like; a document that loses all its words goes."""
    ship(spark)
    return _documents(line_dedup.dedup_lines(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    ship(spark)
    return _documents(shingle_join.keep_first(docs, SHINGLE))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no phrase of a benchmark item stands."""
    ship(spark)
    return _documents(decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their sequence and place in it."""
    ship(spark)
    return packing.pack_documents(docs)[0]


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]
#: Line dedup, SimHash and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = storage.stored(docs, name.replace(" ", "-"))
    return docs
