"""Planned runs, run records of our own samplers, and the commands."""

import pytest

from boxloom import cli
from boxloom.operators.boxes import BoxJoin
from boxloom.plans import runs
from boxloom.sources import boxfile


def test_plan(spark):
    cases = runs.cases(spark, [{"sweep": "n", "x_name": "n", "n": [10, 20], "d": [2], "alpha": [1.0], "sigma": [0.0], "t": [5, 6]}])
    assert cases.count() == 4 and cases.select("workload_id").distinct().count() == 2
    planned = runs.planned(cases, ("oneshot", "count-only", "prepared-query"))
    assert planned.count() == 4 * (8 + 4 + 3)
    assert planned.select("run_group_id", "measurement_mode").distinct().count() == planned.count()


def test_runs_report_records(spark):
    r = spark.createDataFrame([(1, 0, 5), (2, 0, 5)], "id bigint, l0 bigint, u0 bigint")
    join = BoxJoin(r, spark.createDataFrame([(3, 0, 5)], r.schema))
    for algorithm in ("AC", "AS"):
        record = runs.run_one(join, algorithm, "oneshot", 10, "ab" * 32)
        assert (record["status"], record["W"], record["output_length"]) == ("OK", "2", 10) and record["OneShotTime"] > 0
    assert runs.run_one(BoxJoin(r, r.where("id > 9")), "LiftedRT", "count-only", 10, "ab" * 32)["status"] == "EMPTY-JOIN"


def test_late_and_wrong_runs(spark):
    r = spark.createDataFrame([(i, i, i + 5) for i in range(50)], "id bigint, l0 bigint, u0 bigint")
    join = BoxJoin(r, r)
    assert runs.run_one(join, "AC", "oneshot", 10, "ab" * 32, limit=0.0)["status"] == "TO"
    assert runs.run_one(join, "LiftedRT", "count-only", 10, "ab" * 32, expected=1)["status"] == "COUNT-MISMATCH"


def test_suite_goes_on_where_it_ended(spark, tmp_path, capsys):
    path, out = str(tmp_path / "b.bin"), str(tmp_path / "records")
    r = spark.createDataFrame([(1, 0, 5), (2, 0, 5)], "id bigint, l0 bigint, u0 bigint")
    boxfile.save(BoxJoin(r, r), path)
    cases = spark.createDataFrame([(path, "t", 5.0, 5, "t")], "workload_id string, x_name string, x_value double, t bigint, sweep string")
    planned = runs.planned(cases).where("algorithm in ('LiftedRT', 'SweepRT')")
    some = planned.where("algorithm = 'LiftedRT'")
    assert runs.run_suite(some, lambda p: boxfile.load(spark, p), out) == 2
    assert runs.run_suite(planned, lambda p: boxfile.load(spark, p), out) == 2
    rows = spark.read.json(out).collect()
    assert len(rows) == 4 and {(x["status"], x["W"], x["output_length"]) for x in rows} == {("OK", "4", 5)}
    assert {(x["kind"], x["status"]) for x in runs.validate({"w": BoxJoin(r, r)}, 500, ("lifted",)).collect()} == {("lifted", "PASS")}
    manifest = tmp_path / "b.bin.manifest.json"
    manifest.write_text(manifest.read_text().replace('"n_r": 2', '"n_r": 3'))
    with pytest.raises(boxfile.FormatError, match="manifest"):
        boxfile.load(spark, path)


def test_commands(spark, tmp_path, capsys):
    path, out = str(tmp_path / "b.bin"), str(tmp_path / "s")
    assert cli.main(["generate", "--n", "400", "--alpha", "2", path]) == 0
    assert cli.main(["count", path]) == 0 and cli.main(["inspect", path]) == 0
    assert cli.main(["sample", path, out, "-t", "20", "--kind", "lifted"]) == 0
    assert spark.read.parquet(out).count() == 20
    assert '"n_r":200' in capsys.readouterr().out
