"""Stages that compute only what has changed (PIP09, SNK04).

A fingerprint of a scope is the number of its rows and two sums of 64-bit hashes of them: it does not depend on order or partitions, and
those of parts add up. A stage keeps its result by scope and a manifest of the fingerprints that each was made from.
"""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import storage


def fingerprints(rows: DataFrame, scope: list[str]) -> DataFrame:
    """scope, n, h1, h2. Columns count by name and in their order by name; equal rows count each. A null and a blank differ."""
    columns = sorted(rows.columns)
    # a hash skips nulls, so which columns are null is hashed with them
    nulls = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns))
    hashed = [F.sum(F.xxhash64(F.lit(seed), nulls, *columns).cast("decimal(38,0)")).alias(f"h{k}") for k, seed in ((1, "a"), (2, "b"))]
    return rows.groupBy(*scope).agg(F.count("*").alias("n"), *hashed)


def added(parts: DataFrame, scope: list[str]) -> DataFrame:
    """Fingerprints of the parts together."""
    return parts.groupBy(*scope).agg(*(F.sum(c).alias(c) for c in ("n", "h1", "h2")))


def changes(now: DataFrame, before: DataFrame, scope: list[str]) -> DataFrame:
    """scope and change: new, changed, gone or same."""
    key = [F.col(c) for c in scope]
    a, b = now.select(*key, F.struct("n", "h1", "h2").alias("_a")), before.select(*key, F.struct("n", "h1", "h2").alias("_b"))
    a, b = (x.withColumn("_k", F.struct(*scope)).drop(*scope) for x in (a, b))
    both = a.join(b, a["_k"].eqNullSafe(b["_k"]), "full").select(F.coalesce(a["_k"], b["_k"]).alias("k"), "_a", "_b")
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "gone").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return both.select("k.*", change.alias("change"))


class Stage:
    """A stage's folder: results by build, and manifests, of which the last whole one counts.

    ``version`` stands for the code: another one makes all scopes anew. A run that dies leaves the last manifest as it was.
    """

    def __init__(self, spark: SparkSession, where: str, scope: list[str], version: str = ""):
        self.spark, self.where, self.scope, self.version = spark, where, scope, version

    def _builds(self) -> list[str]:
        fs, path = storage.filesystem(f"{self.where}/manifests")
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return []
        folders = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.Directory]
        whole = [f for f in folders if fs.get_file_info(f"{f}/_SUCCESS").type == pafs.FileType.File]
        return sorted(f.rpartition("/")[2] for f in whole)

    def manifest(self) -> DataFrame | None:
        """scope, n, h1, h2, version, build, of the last run."""
        builds = self._builds()
        return self.spark.read.parquet(f"{self.where}/manifests/{builds[-1]}") if builds else None

    def result(self) -> DataFrame | None:
        """What the last run kept and made."""
        told = self.manifest()
        if told is None:
            return None
        builds = [r.build for r in told.select("build").distinct().collect()]  # one for each run that something is left of
        rows = self.spark.read.option("basePath", f"{self.where}/rows").parquet(*(f"{self.where}/rows/build={b}" for b in builds))
        t = told.select(F.struct(*self.scope).alias("_k"), F.col("build").alias("_b"))
        return rows.join(t, F.struct(*(rows[c] for c in self.scope)).eqNullSafe(t["_k"]) & (rows["build"] == t["_b"]), "left_semi").drop("build")

    def run(self, rows: DataFrame, compute, now: DataFrame | None = None) -> DataFrame:
        """Compute the scopes whose rows have changed, by compute(their rows); returns scope and change, of which same cost nothing.

        now: the rows' fingerprints if they are known, so that rows of unchanged scopes are not read. If all is the same, nothing is written.
        """
        now = storage.stored(fingerprints(rows, self.scope) if now is None else now, "fingerprints")
        before = self.manifest()
        valid = now.limit(0) if before is None else before.filter(F.col("version") == self.version)
        found = storage.stored(changes(now, valid, self.scope), "changes")
        if before is not None and valid.count() == before.count() and not found.filter("change <> 'same'").limit(1).count():
            return found
        build = f"{len(self._builds()):08d}-{uuid.uuid4().hex[:8]}"
        todo = found.filter("change in ('new', 'changed')").select(F.struct(*self.scope).alias("_k"))
        out = compute(rows.join(todo, F.struct(*(rows[c] for c in self.scope)).eqNullSafe(todo["_k"]), "left_semi"))
        out.write.parquet(f"{self.where}/rows/build={build}")
        k = F.struct(*self.scope).alias("_k")
        made = now.withColumn("_k", k).join(todo, "_k", "left_semi").drop("_k").withColumns({"version": F.lit(self.version), "build": F.lit(build)})
        kept = found.filter("change = 'same'").select(k)
        if before is not None:
            made = made.unionByName(valid.withColumn("_k", k).join(kept, "_k", "left_semi").drop("_k"))
        made.write.parquet(f"{self.where}/manifests/{build}")
        return found
