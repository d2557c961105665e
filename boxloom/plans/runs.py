"""Planned runs: sweeps exploded into cases, cases into runs of a task, mode and algorithm, with stable ids."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json, stable_hex
from ..operators import boxes, decompose, joins, records, samplers, validation
from ..operators.boxes import BoxJoin
from ..operators.storage import settled
from ..sources import runs as runs_out

#: Modes of each task, and which algorithm kind of ours stands for a name in records.
MODES = {"oneshot": ("time", "memory"), "count-only": ("time",), "prepared-query": ("time",)}
KIND_OF = dict(zip(records.ALGORITHMS, samplers.KINDS))
_AXES = ("n", "d", "alpha", "sigma", "t")
_SWEEP = "sweep string, x_name string, n array<bigint>, d array<int>, alpha array<double>, sigma array<double>, t array<bigint>"


def cases(spark: SparkSession, sweeps: list[dict]) -> DataFrame:
    """One row per case of sweeps {sweep, x_name, n, d, alpha, sigma, t}, each value a list; the workload id doesn't depend on t."""
    df = spark.createDataFrame([tuple(s.get(k) for k in ("sweep", "x_name", *_AXES)) for s in sweeps], _SWEEP)
    for a in _AXES:
        df = df.withColumn(a, F.explode(a))
    x = F.coalesce(*[F.when(F.col("x_name") == a, F.col(a).cast("double")) for a in _AXES])
    fields = [F.col(c).cast("string") for c in ("n", "d", "alpha", "sigma")]
    return df.withColumn("x_value", x).withColumn("workload_id", stable_hex("workload", *fields))


def planned(cases_: DataFrame, tasks: tuple[str, ...] = ("oneshot",)) -> DataFrame:
    """Runs of all cases: each task in its modes with each algorithm that has it; a run group is a case, task and algorithm."""
    spark = cases_.sparkSession
    rows = [(task, mode, a) for task in tasks for mode in MODES[task] for a in records.ALGORITHMS if not (task == "prepared-query" and a == "AS")]
    runs = cases_.join(F.broadcast(spark.createDataFrame(rows, "task string, measurement_mode string, algorithm string")))  # len(rows) <= 15
    quote = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    group = stable_hex("run-group", quote("workload_id"), F.col("t").cast("string"), quote("task"), quote("algorithm"))
    return runs.withColumn("run_group_id", group).withColumn("sample_seed", stable_hex("sample-seed", quote("workload_id"), quote("algorithm")))


def run_one(join: BoxJoin, algorithm: str, task: str, t: int, seed: str, limit: float | None = None, expected: int | None = None) -> dict:
    """Runs one task and reports its record: status, W, output length and times; failures are statuses, not exceptions.

    After `limit` seconds its Spark jobs are cancelled (TO). A count other than `expected` is COUNT-MISMATCH, a sample that
    is no pair of the join MEMBERSHIP-MISMATCH; that check is not timed.
    """
    sc = join.r.sparkSession.sparkContext
    record = {"algorithm": algorithm, "task": task, "t": t, "status": "OK", "W": None, "output_length": None}
    group, late = f"run-{algorithm}-{task}-{uuid.uuid4().hex}", threading.Event()
    sc.setJobGroup(group, f"{algorithm} {task}", interruptOnCancel=True)

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(limit, stop) if limit is not None else None
    try:
        if timer:
            timer.start()
        began = time.time()
        sampler = samplers.make_sampler(KIND_OF[algorithm], join, seed)
        if task == "prepared-query" or algorithm != "AS":
            sampler = sampler.prepare()
        w = sampler.count()
        counted = time.time()
        record["W"] = str(w)
        drawn = None
        if task != "count-only":
            drawn = settled(sampler.sample(t))
            record["output_length"] = drawn.count()
        ended = time.time()
        if timer:
            timer.cancel()
        if late.is_set():
            raise TimeoutError
        name = {"oneshot": "OneShotTime", "count-only": "CountOnlyTime", "prepared-query": "PreparedQueryTime"}[task]
        record[name] = ended - (counted if task == "prepared-query" else began)
        if task == "oneshot" and algorithm != "AS":
            record |= {"PrepareTime": counted - began, "QueryTime": ended - counted}
        record["status"] = sampler.status(t)
        if expected is not None and w != expected:
            record["status"] = "COUNT-MISMATCH"
        elif drawn is not None and not joins.invalid_pairs(join, drawn).isEmpty():
            record["status"] = "MEMBERSHIP-MISMATCH"
    except Exception as e:
        text = str(e)
        kinds = (("OVERFLOW", "INTEGER-OVERFLOW"), ("OutOfMemory", "OOM"), ("finite", "NUMERIC-DEGENERACY"))
        record["status"] = "TO" if late.is_set() else next((status for sign, status in kinds if sign in text), "BENCHMARK-ERROR")
        record["detail"] = text[:300]
    finally:
        if timer:
            timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    return record


def run_suite(planned_runs: DataFrame, workload: Callable[[str], BoxJoin], out: str, limit: float | None = None, identity: Mapping[str, str] | None = None) -> int:
    """Runs what is planned and has no record in `out` yet, one after another, appending each record; returns how many ran.

    A suite that was stopped goes on where it ended: records are JSON lines, and a run is known by its group and mode. With an
    `identity` (values of records.IDENTITY) each record tells it, and records of another one in `out` are an error before anything runs.
    """
    spark = planned_runs.sparkSession
    identity = dict(identity or {})
    if set(identity) - set(records.IDENTITY):
        raise ValueError(f"not of a record's identity: {sorted(set(identity) - set(records.IDENTITY))}")
    if identity and _exists(spark, out):
        before = spark.read.schema(", ".join(f"{k} string" for k in identity)).json(out)
        other = [F.when(~F.col(k).eqNullSafe(F.lit(v)), k) for k, v in identity.items()]
        odd = before.select(F.array_compact(F.array(*other)).alias("fields")).where("size(fields) > 0").first()
        if odd:
            raise ValueError(f"{out} has records of another {', '.join(odd['fields'])}: use another path")
    names = ["run_group_id", "measurement_mode", "workload_id", "algorithm", "task", "t", "x_name", "x_value", "sweep", "sample_seed"]
    todo = planned_runs.select(names)
    done = spark.read.schema("run_group_id string, measurement_mode string").json(out) if _exists(spark, out) else None
    todo = (todo if done is None else records.not_done(todo, done)).orderBy("run_group_id", "measurement_mode").collect()
    for row in todo:
        record = row.asDict() | run_one(workload(row["workload_id"]), row["algorithm"], row["task"], row["t"], row["sample_seed"], limit) | identity
        values = {k: v for k, v in record.items() if k in _KEPT}
        runs_out.append_runs(spark.createDataFrame([tuple(values.get(k) for k in _KEPT)], ", ".join(f"{k} {v}" for k, v in _KEPT.items())), out)
    return len(todo)


#: Columns of a suite's records.
_KEPT = dict.fromkeys((*records.IDENTITY, "run_group_id", "measurement_mode", "workload_id", "algorithm", "task", "x_name", "sweep", "status", "W", "detail"), "string") | {
    "t": "bigint", "output_length": "bigint"
} | dict.fromkeys(("x_value", "OneShotTime", "PrepareTime", "QueryTime", "CountOnlyTime", "PreparedQueryTime"), "double")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def validate(workloads: dict[str, BoxJoin], t: int = 100_000, kinds: tuple[str, ...] = samplers.KINDS, seed: str = "0" * 64) -> DataFrame:
    """(workload, kind, status): the gate over reports of each workload and kind, counts held against the grid join; FAIL, COUNT-MISMATCH or PASS."""
    rows, spark = [], None
    for name, join in workloads.items():
        spark = join.r.sparkSession
        w = joins.count(joins.grid_pairs(join)).first()["w"]
        for kind in kinds:
            sampler = samplers.make_sampler(kind, join, seed).prepare()
            same = sampler.count() == w
            report = validation.distribution_report(join, sampler.sample(t)).first() if same else None
            rows.append((name, kind, same and report["draws"] == t, report and report["p_pairs"], report and report["p_steps"]))
    found = spark.createDataFrame(rows, "workload string, kind string, same boolean, p_pairs double, p_steps double")
    status = F.when(F.col("same"), F.col("status")).otherwise("COUNT-MISMATCH")
    return validation.gate(found).join(found.select("workload", "kind", "same"), ["workload", "kind"]).select("workload", "kind", status.alias("status"))


def describe(join: BoxJoin, t: int, kind: str = "compiled", seed: str = "0" * 64) -> str:
    """Canonical JSON of n_r, n_s, W, density and bits of W."""
    j = join.clean()
    w = decompose.total(decompose.atoms(j)[0]).first()["w"]
    n = [boxes.extent(x).first()["n"] for x in (j.r, j.s)]
    return canonical_json({"n_r": n[0], "n_s": n[1], "W": str(w), "alpha": w / max(1, sum(n)), "bits": w.bit_length(), "t": t, "kind": kind, "seed": seed})
