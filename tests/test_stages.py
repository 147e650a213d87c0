"""Stages compute only what has changed; placements by rank against a plain search."""

import random

from pyspark.sql import functions as F

from junctura import storage
from junctura.operators import curation, stages


def test_fingerprints(spark):
    rows = [(k % 3 if k % 7 else None, f"x{k % 5}", None if k % 4 else k) for k in range(60)]
    df = spark.createDataFrame(rows, "s int, b string, a int")
    plain = lambda d: sorted(map(tuple, d.collect()), key=repr)
    whole = plain(stages.fingerprints(df, ["s"]))
    random.Random(1).shuffle(rows)
    again = spark.createDataFrame(rows, df.schema).repartition(5).select("a", "b", "s")
    assert plain(stages.fingerprints(again, ["s"])) == whole
    parts = stages.fingerprints(df.filter("b = 'x1'"), ["s"]).unionByName(stages.fingerprints(df.filter("b <> 'x1'"), ["s"]))
    assert plain(stages.added(parts, ["s"])) == whole
    one = lambda a, b: plain(stages.fingerprints(spark.createDataFrame([(1, a, b)], "s int, a string, b string"), ["s"]))
    assert one("x", None) != one(None, "x") and one("", None) != one(None, None)
    assert stages.fingerprints(df.limit(0), ["s"]).count() == 0


def test_stage(spark):
    where, made = storage.new_dir(spark, "stage-test"), []
    rows = spark.createDataFrame([(k % 3 if k % 5 else None, k) for k in range(30)], "s int, v int")

    def compute(x):
        made.append(sorted((r.s for r in x.select("s").distinct().collect()), key=repr))
        return x.groupBy("s").agg(F.sum("v").alias("total"))

    def run(df, version="1"):
        found = {r.s: r.change for r in stages.Stage(spark, where, ["s"], version).run(df, compute).collect()}
        stage = stages.Stage(spark, where, ["s"], version)
        assert {r.s: r.total for r in stage.result().collect()} == {r.s: r.total for r in df.groupBy("s").agg(F.sum("v").alias("total")).collect()}
        return found

    assert stages.Stage(spark, where, ["s"]).result() is None
    assert set(run(rows).values()) == {"new"} and len(made) == 1
    builds = stages.Stage(spark, where, ["s"])._builds()
    assert set(run(rows.repartition(3)).values()) == {"same"} and len(made) == 1 and stages.Stage(spark, where, ["s"])._builds() == builds
    assert run(rows.withColumn("v", F.when(F.col("s") == 1, F.col("v") + 1).otherwise(F.col("v")))) == {0: "same", 1: "changed", 2: "same", None: "same"} and made[-1] == [1]
    assert run(rows.filter("s = 1 or s is null"))[0] == "gone" and made[-1] == [1]
    assert set(run(rows.filter("s = 1"), "2").values()) == {"new"} and made[-1] == [1]

    def dies(x):
        raise RuntimeError("lost")

    try:
        stages.Stage(spark, where, ["s"], "2").run(rows, dies)
    except RuntimeError:
        pass
    assert [r.s for r in stages.Stage(spark, where, ["s"], "2").result().collect()] == [1]


def test_approximate_places(spark):
    r = random.Random(4)
    items = [(k % 4, k, r.choice(["A", " a", "b", None]), r.choice([None, 0, 1, 2, 3, 5, 8]), *((r.random(), r.random()) if r.random() < 0.5 else (None, None))) for k in range(200)]
    df = spark.createDataFrame(items, "cluster_key int, ref int, display_name string, rank int, lat double, lon double")
    name = lambda n: (n or "").strip().lower()
    for x in curation.approximate_places(df).collect():
        c, ref, n, rank, lat, lon = items[x.ref]
        peers = sorted((abs((p[3] or 9999) - (rank or 9999)), p[3] or 9999, p[1], p[4], p[5]) for p in items if p[0] == c and name(p[2]) == name(n) and p[4] is not None)[:2]
        want = (lat, lon) if lat is not None else tuple(sum(p[j] for p in peers) / len(peers) for j in (3, 4)) if peers else (None, None)
        assert x.approx == (lat is None and bool(peers)) and all(a == b or abs(a - b) < 1e-12 for a, b in zip((x.lat, x.lon), want, strict=True))


def test_rewritten_archive(spark, tmp_path):
    import zipfile

    from junctura.operators import export

    rows = spark.createDataFrame([(k, f"n{k % 3}") for k in range(20)], "id int, name string")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr(zipfile.ZipInfo("feed/notes.txt", (2020, 5, 6, 7, 8, 10)), "kept " * 999, zipfile.ZIP_DEFLATED)
        z.writestr("feed/stops.txt", "id,name\n1,x\n")
        z.writestr("übung.bin", bytes(range(256)) * 9, zipfile.ZIP_STORED)
    paths = [f"file://{tmp_path}/{n}.zip" for n in "abc"]
    for target in paths[1:]:
        export.rewrite_archive(paths[0], target, {"stops": rows.repartition(3), "trips": rows.limit(0)}, {"stops": ["id"], "trips": ["id"]})
    assert (tmp_path / "b.zip").read_bytes() == (tmp_path / "c.zip").read_bytes() and sorted(p.name for p in tmp_path.iterdir()) == ["a.zip", "b.zip", "c.zip"]
    with zipfile.ZipFile(tmp_path / "a.zip") as a, zipfile.ZipFile(tmp_path / "b.zip") as b:
        assert b.testzip() is None and b.namelist() == ["feed/notes.txt", "feed/stops.txt", "übung.bin", "trips.txt"]
        for n in ("feed/notes.txt", "übung.bin"):
            x, y = a.getinfo(n), b.getinfo(n)
            assert a.read(n) == b.read(n) and (x.CRC, x.compress_size, x.compress_type, x.date_time) == (y.CRC, y.compress_size, y.compress_type, y.date_time)
        assert b.read("feed/stops.txt").decode() == "id,name\n" + "".join(f"{k},n{k % 3}\n" for k in range(20)) and b.read("trips.txt") == b"id,name\n"
        assert b.getinfo("feed/stops.txt").date_time == (2024, 1, 1, 0, 0, 0)
