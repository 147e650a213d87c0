"""Distance clusters and components over tables whose files are small (GRF01, GRF03)."""

import itertools
import math
import random

from junctura.operators import graph


def test_spots_and_cells_against_all_pairs(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, rng.choice("ab"), float(rng.randrange(0, 6000, 50)), float(rng.randrange(0, 3000, 50))) for k in range(150)]
    rows += [(1000 + k, "a", 0.0, 0.0) for k in range(40)] + [(2000, "b", None, 1.0), (2001, "c", -499.9, -0.1), (2002, "c", 0.1, -0.1), (2003, "c", 500.1, 0.0), (2004, "c", 1000.2, 0.0)]
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, q in itertools.combinations(rows, 2):
        if p[1] == q[1] and None not in p + q and math.hypot(p[2] - q[2], p[3] - q[3]) <= 500:
            a, b = find(p[0]), find(q[0])
            root[max(a, b)] = min(a, b)
    spark.createDataFrame(rows, "id long, name string, x double, y double").write.parquet(str(tmp_path / "p"))
    found = graph.eps_clusters(spark.read.parquet(str(tmp_path / "p")))
    assert {r.id: r.cluster for r in found.collect()} == {k: find(k) for k in root}
    # a file's size says little of a table's: no side is brought to the driver
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_parts_grow_with_edges(spark, monkeypatch):
    """Many edges are dealt over more parts in every round, and the session is left as it was."""
    key, seen = "spark.sql.shuffle.partitions", []
    stored = graph.storage.Tables.stored
    monkeypatch.setattr(graph.storage.Tables, "stored", lambda self, df, name: seen.append(spark.conf.get(key)) or stored(self, df, name))
    monkeypatch.setattr(graph, "PART_ROWS", 10, raising=False)
    before = spark.conf.get(key)
    chain = spark.range(90).selectExpr("id as a", "id + 1 as b")
    assert {(r.node, r.component) for r in graph.components(chain).collect()} == {(k, 0) for k in range(91)}
    assert set(seen[1:]) == {"9"} and spark.conf.get(key) == before
