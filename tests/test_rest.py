"""Ranges, selection, records, hashing, files, the generator and the stream."""

import functools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from boxloom.functions import hashing
from boxloom.operators import diagnostics, generator, prefix, ranges, records, strata, validation
from boxloom.operators.boxes import BoxJoin
from boxloom.plans import catalog
from boxloom.plans.more import run_records
from boxloom.sources import boxfile, runs
from boxloom.streaming import activity

RANGE = "qid bigint, lo0 double, hi0 double, lo0_strict boolean, hi0_strict boolean"


def test_boundaries_of_doubles(spark):
    tiny = math.nextafter(0.0, 1.0)
    points = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, tiny), (4, 1.0), (5, -0.0)], "id bigint, x0 double")
    queries = spark.createDataFrame([(1, 0.0, 0.0, False, False), (2, 0.0, 1.0, True, True), (3, 1.0, 0.0, False, False), (4, None, None, True, True), (5, 1.0, 1.0, True, False)], RANGE)
    got = {r["qid"]: r["n"] for r in ranges.range_count(points, queries, 1).collect()}
    assert got == {1: 3, 2: 1, 3: 0, 4: 5, 5: 0}
    assert {r["qid"]: r["n"] for r in ranges.range_count(points, queries, 1, 0.25).collect()} == got


def test_changing_points(spark):
    rnd = random.Random(3)
    points = spark.createDataFrame([(i, float(i % 7)) for i in range(12)], "id bigint, x0 double")
    log, queries, want, active = [], [], {}, set()
    for seq in range(300):
        if rnd.random() < 0.6:
            i = rnd.randrange(12)
            active ^= {i}
            log.append((seq, i, 1 if i in active else -1))
        else:
            lo, hi = rnd.choice([None, 0.0, 2.0]), rnd.choice([None, 4.0, 6.0])
            a, b = rnd.random() < 0.5, rnd.random() < 0.5
            queries.append((seq, lo, hi, a, b, seq))
            ok = lambda x: (lo is None or x > lo or (x == lo and not a)) and (hi is None or x < hi or (x == hi and not b))  # noqa: E731, B023
            want[seq] = sum(ok(float(i % 7)) for i in active)
    log_df = spark.createDataFrame(log, "seq bigint, id bigint, delta int")
    q = spark.createDataFrame(queries, RANGE + ", seq bigint")
    assert {r["qid"]: r["n"] for r in ranges.active_range_count(points, log_df, q, 1).collect()} == want
    assert ranges.activity_errors(log_df).count() == 0
    bad = spark.createDataFrame([(1, 5, 1), (2, 5, 1), (3, 6, -1)], "seq bigint, id bigint, delta int")
    assert {r["seq"] for r in ranges.activity_errors(bad).collect()} == {2, 3}


def test_range_samples(spark):
    points = spark.createDataFrame([(i, float(i)) for i in range(10)], "id bigint, x0 double")
    queries = spark.createDataFrame([(1, 2.0, 5.0, False, True), (2, 50.0, 60.0, False, False)], RANGE)
    rows = ranges.range_sample(points, queries, 1, 900, "seed").collect()
    assert len(rows) == 900 and {r["id"] for r in rows} == {2, 3, 4} and all(sum(r["id"] == k for r in rows) > 230 for k in (2, 3, 4))


def test_half_split_and_holm_in_ranges(spark, sf_dir, monkeypatch):
    for module in (strata, validation):
        monkeypatch.setattr(module, "running", functools.partial(prefix.running, rows=3))
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{sf_dir}/part.parquet'")
    assert sorted(map(tuple, catalog.QUERIES["split_half_part"](spark, sf_dir).select("p_partkey", "side").collect())) == sorted(con.sql(f"select p_partkey, side from ({catalog.SQL['split_half_part']})").fetchall())
    p = [0.0001 * (i + 1) ** 2 for i in range(20)]
    got = validation.holm(spark.createDataFrame([(f"{i:02}", x) for i, x in enumerate(p)], "label string, p double"), 0.05).collect()
    assert {r["label"] for r in got if r["rejected"]} == {f"{i:02}" for i in range(20) if all(p[j] <= 0.05 / (20 - j) for j in range(i + 1))}


def test_half_split_ignores_order(spark):
    rows = [(i, 5 if i < 5 else 4, 10_000.0 * (i % 2), 0.0) for i in range(9)]
    df = lambda x: spark.createDataFrame(x, "id bigint, kind int, x double, y double").withColumn("tx", strata.tile(F.col("x"), 10_000)).withColumn("ty", strata.tile(F.col("y"), 10_000))
    split = lambda x: sorted((r["id"], r["side"]) for r in strata.half_split(df(x), ["kind", "tx", "ty"], "id", 5).collect())
    got = split(rows)
    assert got == split(rows[::-1]) and sum(s == "R" for _, s in got) == 5
    with pytest.raises(Exception, match="halves"):
        strata.half_split(df(rows), ["kind", "tx", "ty"], "id", 9).collect()


def test_quotas(spark):
    sizes = spark.createDataFrame([("a", 3), ("b", 2)], "k string, n bigint")
    assert {r["k"]: r["quota"] for r in strata.largest_remainder(sizes, "n", 4, ["k"]).collect()} == {"a": 2, "b": 2}
    with pytest.raises(Exception, match="more is asked"):
        strata.largest_remainder(sizes, "n", 6, ["k"]).collect()


def test_hashes(spark):
    assert hashing.canonical_json({"b": [1, -0.0, True, None], "a": "é"}) == '{"a":"é","b":[1,0.0,true,null]}'
    with pytest.raises(ValueError):
        hashing.canonical_json(float("nan"))
    row = spark.createDataFrame([(3, 4)], "a int, b int").select(hashing.stable_hex("t", hashing.canonical_integers(F.col("a"), F.col("b"))).alias("h")).first()
    assert row["h"] == hashing.stable_digest("t", [3, 4]).hex()
    first = int(hashing.splitmix(__import__("numpy").zeros(1, "uint64"))[0])
    assert first == 0xE220A8397B1DCDAF
    p = spark.createDataFrame([(1, 2)], "a bigint, b int").select(hashing.point_priority(F.col("a"), F.col("b"), "t").alias("p")).first()["p"]
    assert len(p) == 16
    j = spark.createDataFrame([('{"b": 1, "a": [2.0]}',), (None,)], "x string").select(hashing.canonical_json_udf("x").alias("x")).collect()
    assert [r["x"] for r in j] == ['{"a":[2.0],"b":1}', None]


def test_records(spark, tmp_path):
    r = run_records(spark)
    report = records.RunReport(r)
    sections = report.sections()
    assert {x["rule"] for x in sections["preflight"].collect()} == {"workload-config"}
    assert report.reconciled.where("status = 'COUNT-MISMATCH'").count() == 8
    runs.append_runs(r, str(tmp_path / "runs"))
    back = runs.read_runs(spark, str(tmp_path / "runs"))
    assert back.count() == 48 and records.metrics_long(records.reconciled(back)).count() == sections["metrics"].count()
    runs.write_report(report, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report/metrics_csv")).count() == sections["metrics"].count()
    one = r.where("run_group_id = 'g0'").unionAll(r.where("run_group_id = 'g0'"))
    with pytest.raises(Exception, match="several values"):
        records.metrics_long(records.reconciled(one)).collect()


def test_box_files(spark, tmp_path):
    r = spark.createDataFrame([(1, 0.5, -1.0, 2.0, 3.0), (7, 0.0, 0.0, 1.0, 1.0)], "id bigint, l0 double, l1 double, u0 double, u1 double")
    s = spark.createDataFrame([(2, 0.0, 0.0, 9.0, 9.0)], r.schema)
    path = str(tmp_path / "x.bin")
    boxfile.save(BoxJoin(r, s), path)
    back = boxfile.load(spark, path)
    assert sorted(back.r.collect()) == sorted(r.collect()) and back.s.collect() == s.collect()
    with open(path, "r+b") as f:
        f.seek(-1, 2)
        last = f.read(1)
        f.seek(-1, 2)
        f.write(bytes([last[0] ^ 1]))
    with pytest.raises(boxfile.FormatError, match="SHA"):
        boxfile.load(spark, path)
    with pytest.raises(boxfile.FormatError):
        boxfile.save(BoxJoin(r, s.withColumn("u0", F.col("l0"))), str(tmp_path / "y.bin"))


@pytest.mark.parametrize("family,cv", [("fixed", 1.0), ("exponential", 1.0), ("lognormal", 0.7), ("normal", 0.5)])
def test_generator(spark, family, cv):
    from boxloom.operators import decompose

    config = generator.BoxConfig(3000, 2000, 2, 4.0, family, cv, 0.3, tolerance=0.1)
    found = generator.solve(config, 3, sample=20_000, batch=200_000)
    assert found.status == "CERTIFIED" and 3.6 <= found.alpha_low <= found.alpha_high <= 4.4
    j = generator.generate(spark, config, found, 3)
    w = decompose.total(decompose.atoms(j)[0]).first()["w"]
    assert abs(w / 5000 - 4.0) < 0.8
    assert j.r.count() == 3000 and j.s.agg(F.min("id")).first()[0] == 3000
    again = generator.generate(spark, config, found, 3)
    assert sorted(again.r.repartition(3).collect()) == sorted(j.r.collect())
    with pytest.raises(ValueError):
        generator.BoxConfig(10, 10, 2, 6.0)


def test_interval_probability():
    p = generator.overlap_probability
    import numpy as np

    assert p(np.array([0.1]), np.array([0.2]))[0] == pytest.approx(1 - 0.7**2 / (0.9 * 0.8)) and p(np.array([0.4]), np.array([0.6]))[0] == 1.0


def test_exact_sums(spark):
    from fractions import Fraction

    rnd = random.Random(1)
    x = [rnd.random() * 10 ** rnd.randint(-300, 300) * rnd.choice([1, -1]) for _ in range(300)] + [5e-324, 0.0, 1e308, -1e308]
    got = diagnostics.exact_sum(spark.createDataFrame([(v,) for v in x], "v double"), "v")
    assert Fraction(got, 2**1074) == sum(map(Fraction, x))


def test_activity_stream(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 3, -1), (1, 4, -1)], "id bigint, seq bigint, delta int").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("id bigint, seq bigint, delta int").parquet(str(tmp_path / "log"))
    q = activity.followed(stream).writeStream.format("memory").queryName("activity").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["seq"]: (r["active"], r["valid"]) for r in spark.sql("select * from activity").collect()} == {1: (True, True), 2: (True, False), 3: (False, False), 4: (False, True)}


def test_diagnostics(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 2.0), (2, 0.0, 1.0, 4.0, 2.0)], "id bigint, l0 double, l1 double, u0 double, u1 double")
    assert {r["axis"]: r["fraction"] for r in diagnostics.duplicate_endpoints(df).collect()} == {0: 0.25, 1: 0.25}
    assert diagnostics.shape_quantiles(df).count() == 5
