"""Fingerprints of collections, digest trees, manifests of files, and publishing of run records."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from boxloom.operators import fingerprints as fp
from boxloom.operators import records, strata
from boxloom.operators.boxes import BoxJoin
from boxloom.plans import runs
from boxloom.sources import boxfile, collections, publish


def _digest(*values):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def _multiset(digests):
    return ",".join(str(sum(int(d[15 * i : 15 * i + 15], 16) for d in digests)) for i in range(fp.LANES))


def test_fingerprint_is_of_rows_not_of_order(spark):
    rows = [(1, "a"), (1, "a"), (2, None), (3, "ü,1:b"), (None, "")]
    df = spark.createDataFrame(rows, "k bigint, `x.y` string")
    want = _multiset([_digest(*r) for r in rows])
    assert [tuple(r) for r in fp.fingerprints(df).collect()] == [(5, want)]
    assert fp.fingerprints(df.orderBy(F.desc("k")).repartition(3)).first()["fingerprint"] == want
    assert fp.fingerprints(df.distinct()).first()["fingerprint"] != want
    assert tuple(fp.fingerprints(df.limit(0)).first()) == (0, "")
    cut = spark.createDataFrame([("a", "bc"), ("ab", "c")], "k string, v string")
    assert fp.fingerprints(cut, by=()).first()["rows"] == 2 and cut.select(fp.row_digest(cut)).distinct().count() == 2
    assert fp.fingerprints(spark.createDataFrame([(bytearray(b"\xff\x00"),)], "b binary")).first()["rows"] == 1


def test_groups_add_up(spark):
    df = spark.range(1000).selectExpr("if(id < 600, 0, id % 3) as g", "id", "id * id as v")
    found = {r["g"]: r for r in fp.fingerprints(df, by=["g"]).collect()}
    for g in range(3):
        ids = [i for i in range(1000) if (0 if i < 600 else i % 3) == g]
        assert (found[g]["rows"], found[g]["fingerprint"]) == (len(ids), _multiset([_digest(i, i * i) for i in ids]))


def test_shared(spark):
    a = spark.range(50).withColumn("x", F.lit(1))
    got = {r["collection"]: (r["rows"], r["same"]) for r in fp.shared({"a": a, "b": a.withColumn("x", F.lit(2)).repartition(5), "c": a.where("id > 0"), "d": a.unionAll(a.limit(1)), "e": a.limit(0)}, ["id"]).collect()}
    assert got == {"a": (50, True), "b": (50, True), "c": (49, False), "d": (51, False), "e": (0, False)}


def test_tree_against_a_loop(spark):
    keys = [*range(-3, 700, 7), 70_000, 2**40, None, None]
    df = spark.createDataFrame([(k, f"v{i}") for i, k in enumerate(keys)] + [(4, "again")], "k bigint, v string")
    rows = [(k, f"v{i}") for i, k in enumerate(keys)] + [(4, "again")]
    at = {}
    for k in {r[0] for r in rows}:
        own = [_digest(*r) for r in rows if r[0] == k]
        at[k] = (len(own), hashlib.sha256(f"{len(own)};{_multiset(own)}".encode()).hexdigest())
    leaves = fp.leaves(df, "k")
    assert {r["node"]: (r["rows"], r["digest"]) for r in leaves.collect()} == at
    want = {}
    for level in range(1, 9):
        above = {}
        for k in sorted(at, key=lambda k: (k is not None, k or 0)):
            above.setdefault(None if k is None else k >> fp.BITS, []).append((k, *at[k]))
        at = {p: (sum(c[1] for c in kids), hashlib.sha256(",".join(f"{'-' if c[0] is None else c[0]}:{c[2]}" for c in kids).encode()).hexdigest()) for p, kids in above.items()}
        want |= {(level, p): v for p, v in at.items()}
    assert {(r["level"], r["node"]): (r["rows"], r["digest"]) for r in fp.tree(leaves, 8).collect()} == want


def test_changes_are_named(spark):
    a = spark.range(1000).withColumn("v", F.lit("x"))
    b = a.where("id <> 5").withColumn("v", F.expr("if(id = 300, 'y', v)")).unionAll(spark.createDataFrame([(5000, "x"), (None, "z"), (7, "x")], "id bigint, v string"))
    one, two = fp.leaves(a, "id"), fp.leaves(b, "id")
    assert {tuple(r) for r in fp.changed(one, two).collect()} == {(5, "removed", 1, None), (300, "changed", 1, 1), (5000, "added", None, 1), (None, "added", None, 1), (7, "changed", 1, 2)}
    nodes = fp.changed(fp.tree(one, 1), fp.tree(two, 1), on=("level", "node"))
    assert {(r["node"], r["change"]) for r in nodes.collect()} == {(0, "changed"), (1, "changed"), (19, "added"), (None, "added")}
    assert fp.changed(one, fp.leaves(a.repartition(7), "id")).isEmpty()


def test_manifest_of_collections(spark, tmp_path):
    folder = str(tmp_path / "c")
    a = spark.range(100).selectExpr("id", "id * 2 as l0")
    told = collections.write_collections({"one": a.repartition(3), "two": a.withColumn("l0", F.col("l0") + 1).repartition(2), "none": a.limit(0)}, folder)
    assert told.where("file <> ''").groupBy("collection").agg(F.sum("rows")).count() == 2
    assert collections.verify(spark, folder).isEmpty()
    assert [tuple(r) for r in collections.verify(spark, folder, same_ids=True).where("collection <> 'none'").collect()] in ([("one", "", "ids differ"), ("two", "", "ids differ")], [("two", "", "ids differ"), ("one", "", "ids differ")])
    files = sorted(Path(folder, "one").glob("*.parquet"))
    altered = spark.read.parquet(str(files[0])).withColumn("l0", F.when(F.col("id") == F.lit(spark.read.parquet(str(files[0])).first()["id"]), -1).otherwise(F.col("l0")))
    altered.coalesce(1).write.parquet(str(tmp_path / "x"))
    files[0].write_bytes(next((tmp_path / "x").glob("*.parquet")).read_bytes())
    files[1].rename(files[1].with_name("moved.parquet"))
    for crc in Path(folder, "one").glob(".*.crc"):
        crc.unlink()
    got = {(r["collection"], r["file"], r["problem"]) for r in collections.verify(spark, folder).collect()}
    assert got == {("one", files[0].name, "changed"), ("one", files[1].name, "missing"), ("one", "moved.parquet", "unexpected")}
    with pytest.raises(ValueError, match="manifest"):
        collections.write_collections({"manifest": a}, folder)


def test_parts_are_read_by_name(spark, tmp_path):
    spark.range(3).selectExpr("id", "id as a").write.parquet(str(tmp_path / "p"))
    spark.range(2).selectExpr("'s' as b", "id").write.parquet(str(tmp_path / "q"))
    df = collections.read_parts(spark, str(tmp_path / "p"), str(tmp_path / "q"))
    assert set(df.columns) == {"id", "a", "b"} and df.where("a is null and b = 's'").count() == 2 and df.count() == 5


def _records(spark, commit="c", **odd):
    """A set of runs that may be published, but for what `odd` sets in the first record."""
    rows = []
    for a in records.ALGORITHMS:
        for mode in ("time", "memory"):
            rows.append({"machine_id": "m", "code_commit": commit, "build_sha256": "b", "experiment_config_sha256": "e", "algorithm_config_sha256": f"a-{a}", "workload_config_sha256": "w", "run_group_id": f"g-{a}",
                         "measurement_mode": mode, "task": "oneshot", "algorithm": a, "experiment_id": "x", "dataset_type": "synthetic", "dataset_id": "d", "workload_id": "w0", "workload_sha256": "h", "sweep": "N", "x_name": "N",
                         "x_value": 1.0, "status": "OK", "W": "17", "t": 10, "data_seed": 0, "sample_seed_id": 0, "process_repeat_id": 0, "output_length": 10, "OneShotTime": 1.5 if mode == "time" else None})
    rows[0] |= odd
    names = [f.split(" ")[0] for f in records.SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], records.SCHEMA)


def test_publish_and_roll_back(spark, tmp_path):
    out = str(tmp_path / "set")
    with pytest.raises(publish.PublishError, match="nothing is published"):
        publish.published(spark, out)
    with pytest.raises(publish.PublishError, match="nothing is staged"):
        publish.finalize(spark, out)
    publish.stage(_records(spark).where("algorithm = 'AC'"), out)
    with pytest.raises(publish.PublishError, match="coverage"):
        publish.finalize(spark, out)
    publish.stage(_records(spark).where("algorithm <> 'AC'"), out)  # the staged part is still there
    assert publish.finalize(spark, out) == "v000001" and not publish.exists(spark, publish.staging(out))
    got = publish.published(spark, out)
    assert got.count() == 8 and got.where("consistency_admitted and count_consistency_checked").count() == 8
    publish.stage(_records(spark, "c2"), out)
    assert publish.finalize(spark, out) == "v000002" and publish.versions(spark, out) == ["v000001", "v000002"]
    assert publish.published(spark, out).select("code_commit").distinct().first()[0] == "c2"
    assert publish.roll_back(spark, out) == "v000001" and publish.published(spark, out).first()["code_commit"] == "c"
    with pytest.raises(publish.PublishError, match="no version before"):
        publish.roll_back(spark, out)
    publish.stage(_records(spark, "c3"), out)
    assert publish.finalize(spark, out) == "v000003"


@pytest.mark.parametrize(
    ("odd", "said"),
    [
        ({"W": "18"}, "disagree"), ({"output_length": 9}, "disagree"), ({"W": None}, "disagree"), ({"machine_id": "n"}, "identity:machine_id"), ({"code_commit": None}, "identity:code_commit"),
        ({"algorithm_config_sha256": "z"}, "algorithm-config"), ({"workload_config_sha256": "z"}, "workload-config"), ({"run_group_id": "g-AS"}, "run-key"), ({"sample_seed_id": 1}, "sample-seed"),
        ({"process_repeat_id": 1}, "repeats"), ({"data_seed": 1}, "synthetic-seed"), ({"dataset_type": "other"}, "dataset-type"), ({"measurement_mode": "memory"}, "run-key"), ({"dataset_type": "real"}, "real-seed"),
    ],
)
def test_what_may_not_be_published(spark, tmp_path, odd, said):
    df = _records(spark, **odd)
    with pytest.raises(publish.PublishError, match="preflight|disagree") as e:
        publish.check(df)
    assert said in str(e.value) or any(r["rule"] == said for r in records.preflight(df).collect())


def test_a_failed_write_leaves_the_version_before(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "set")
    publish.stage(_records(spark), out)
    publish.finalize(spark, out)
    publish.stage(_records(spark, "c2"), out)
    with monkeypatch.context() as m:
        m.setattr(publish, "_point", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            publish.finalize(spark, out)
    assert publish.published(spark, out).first()["code_commit"] == "c" and publish.exists(spark, publish.staging(out))
    assert publish.finalize(spark, out) == "v000003" and publish.published(spark, out).first()["code_commit"] == "c2"


def test_suite_of_another_identity(spark, tmp_path):
    path, out = str(tmp_path / "b.bin"), str(tmp_path / "records")
    r = spark.createDataFrame([(1, 0, 5), (2, 0, 5)], "id bigint, l0 bigint, u0 bigint")
    boxfile.save(BoxJoin(r, r), path)
    cases = spark.createDataFrame([(path, "t", 5.0, 5, "t")], "workload_id string, x_name string, x_value double, t bigint, sweep string")
    planned = runs.planned(cases, ("count-only",)).where("algorithm in ('LiftedRT', 'SweepRT')")
    load = lambda p: boxfile.load(spark, p)
    assert runs.run_suite(planned.where("algorithm = 'SweepRT'"), load, out, identity={"machine_id": "m", "code_commit": "c"}) == 1
    with pytest.raises(ValueError, match="another code_commit"):
        runs.run_suite(planned, load, out, identity={"machine_id": "m", "code_commit": "d"})
    assert runs.run_suite(planned, load, out, identity={"machine_id": "m", "code_commit": "c"}) == 1
    with pytest.raises(ValueError, match="identity"):
        runs.run_suite(planned, load, out, identity={"host": "m"})


def test_selection_summary(spark):
    a = spark.createDataFrame([(1, 1, None), (1, 2, 5), (None, 2, 5), (None, 2, 6)], "u bigint, m bigint, x bigint")
    assert [tuple(r) for r in strata.selection_summary(a, a.where("x = 5"), "u", ["m", "x"]).collect()] == [("candidates", 4, 2, 3), ("selected", 2, 2, 1)]
    assert [tuple(r)[1:] for r in strata.selection_summary(a.limit(0), a.limit(0), "u", ["m", "x"]).collect()] == [(0, 0, 0)] * 2
