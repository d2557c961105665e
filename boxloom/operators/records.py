"""Run records: checks before aggregation, reconciliation of counts, and the sections of a report as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names in run records (fixed values).
METRICS = (
    "OneShotTime", "PrepareTime", "QueryTime", "CountOnlyTime", "PreparedQueryTime", "InputMemory", "BaselineMemory", "PeakMemoryTotal", "PeakMemoryIncremental",
    "PeakMemoryAux", "ProcessMaxRSS", "MemoryAfterPrepare",
)
IDENTITY = ("machine_id", "code_commit", "build_sha256", "experiment_config_sha256")
BASE = ("experiment_id", "dataset_type", "dataset_id", "sweep", "x_name", "x_value", "t", "level", "algorithm")
ALGORITHMS, BASELINES = ("AC", "AS", "SweepRT", "LiftedRT"), ("LiftedRT", "SweepRT")
COVERAGE = {"oneshot": [(a, m) for a in ALGORITHMS for m in ("time", "memory")], "count-only": [(a, "time") for a in ALGORITHMS], "prepared-query": [(a, "time") for a in ALGORITHMS if a != "AS"]}
GOOD, EXHAUSTED = ("OK", "EMPTY-JOIN"), ("OOM", "MEMORY-CAP-EXCEEDED", "TO")
SCHEMA = ", ".join(
    [*(f"{c} string" for c in (*IDENTITY, "algorithm_config_sha256", "workload_config_sha256", "run_group_id", "measurement_mode", "task", "algorithm", "experiment_id", "dataset_type", "dataset_id", "workload_id", "workload_sha256", "subset_id", "sweep", "x_name", "level", "status", "W")),
     *(f"{c} bigint" for c in ("t", "data_seed", "sample_seed_id", "process_repeat_id", "output_length")), "x_value double", *(f"{m} double" for m in METRICS)]
)


def whole(records: DataFrame) -> DataFrame:
    """Missing optional columns as null; the task is oneshot unless told."""
    missing = [c.strip().split(" ") for c in SCHEMA.split(",")]
    out = records.select(*records.columns, *[F.lit(None).cast(t).alias(c) for c, t in missing if c not in records.columns])
    return out.withColumn("task", F.coalesce("task", F.lit("oneshot")))


def number(c: Column) -> Column:
    """A finite number, or null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _several(records: DataFrame, rule: str, by: Sequence[str], value: Column, bad: Column) -> DataFrame:
    """(rule, key, found) of the groups whose set of values is bad (null counts as a value)."""
    groups = records.groupBy(*by).agg(F.collect_set(F.coalesce(value.cast("string"), F.lit("<null>"))).alias("found")) if by else records.agg(F.collect_set(F.coalesce(value.cast("string"), F.lit("<null>"))).alias("found"))
    key = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in by]) if by else F.lit("")
    return groups.where(bad).select(F.lit(rule).alias("rule"), key.alias("key"), F.array_join(F.sort_array("found"), ";").alias("found"))


def preflight(records: DataFrame) -> DataFrame:
    """All violations (rule, key, found) of what a set of runs must be; a publishable set gives no row. One grouping per rule."""
    r = whole(records)
    mixed = (F.size("found") != 1) | F.array_contains("found", "<null>") | F.array_contains("found", "")
    not_zero = ~((F.size("found") == 1) & F.array_contains("found", "0"))
    rules = [_several(r, f"identity:{c}", [], F.col(c), mixed) for c in IDENTITY]
    rules.append(_several(r, "algorithm-config", ["algorithm", "task"], F.col("algorithm_config_sha256"), mixed))
    rules.append(_several(r, "workload-config", ["workload_id"], F.col("workload_config_sha256"), mixed | F.col("workload_id").isNull()))
    twice = r.groupBy("run_group_id", "measurement_mode").agg(F.count("*").alias("n")).where("n <> 1")
    rules.append(twice.select(F.lit("run-key"), F.concat_ws(",", F.coalesce("run_group_id", F.lit("<null>")), F.coalesce("measurement_mode", F.lit("<null>"))), F.col("n").cast("string")))
    rules.append(_several(r, "sample-seed", [], F.col("sample_seed_id"), not_zero))
    group = ["experiment_id", "dataset_id", "workload_id", "t", "data_seed"]
    rules.append(_several(r, "repeats", [*group, "algorithm", "measurement_mode", "task", "sample_seed_id"], F.col("process_repeat_id"), not_zero))
    seeds = ["experiment_id", "dataset_id", "sweep", "x_name", "x_value", "t", "level", "algorithm", "measurement_mode", "task", "sample_seed_id"]
    rules.append(_several(r.where("dataset_type = 'synthetic'"), "synthetic-seed", seeds, F.col("data_seed"), not_zero))
    rules.append(r.where("dataset_type = 'real' and data_seed is not null").groupBy("dataset_id").agg(F.lit(1)).select(F.lit("real-seed"), "dataset_id", F.lit("not null")))
    fixed = F.concat_ws("/", *[F.coalesce(c, F.lit("<null>")) for c in ("workload_id", "workload_sha256", "subset_id")])
    real = r.where("dataset_type = 'real'").withColumn("at", F.when(F.col("x_name") == "t", F.lit(None)).otherwise(F.col("x_value").cast("string")))
    rules.append(_several(real, "real-workload", ["experiment_id", "dataset_id", "x_name", "at"], fixed, (F.size("found") != 1) | F.exists("found", lambda x: x.startswith("<null>/") | x.contains("/<null>/"))))
    rules.append(r.where("dataset_type is null or dataset_type not in ('synthetic', 'real')").groupBy("dataset_type").agg(F.lit(1)).select(F.lit("dataset-type"), F.coalesce("dataset_type", F.lit("<null>")), F.lit("")))
    expected = reduce(lambda a, kv: F.when(F.col("task") == kv[0], F.lit(";".join(sorted(f"{x}/{m}" for x, m in kv[1])))).otherwise(a), COVERAGE.items(), F.lit("unknown task"))
    pair = F.concat_ws("/", "algorithm", "measurement_mode")
    rules.append(_several(r, "coverage", [*group, "process_repeat_id", "task", "sample_seed_id"], pair, F.array_join(F.sort_array("found"), ";") != expected))
    return reduce(DataFrame.unionAll, rules)


def reconciled(records: DataFrame) -> DataFrame:
    """Records with consistency_admitted, count_consistency_checked and, where counts of one workload differ, status COUNT-MISMATCH.

    Successful runs of a workload must agree on W and tell it; the time and memory run of one case must agree on status
    and output length. Both are sets over a key, so a window suffices and no pairs are formed.
    """
    r = whole(records)
    good = F.col("status").isin(*GOOD)
    counts = Window.partitionBy("dataset_id", "workload_id", "workload_sha256", "data_seed", "sample_seed_id")
    modes = Window.partitionBy("experiment_id", "dataset_id", "workload_id", "t", "data_seed", "sample_seed_id", "process_repeat_id", "task", "algorithm")
    differ = lambda c, w: F.size(F.collect_set(F.coalesce(c.cast("string"), F.lit("<null>"))).over(w)) > 1
    odd_w = (F.size(F.collect_set(F.when(good, F.col("W"))).over(counts)) > 1) | (F.sum(F.when(good & F.col("W").isNull(), 1).otherwise(0)).over(counts) > 0)
    out = r.withColumn("_w", F.coalesce(good & odd_w, F.lit(False))).withColumn("_m", differ(F.col("status"), modes) | differ(F.col("output_length"), modes))
    return (
        out.withColumn("original_status", F.when(F.col("_w"), F.col("status")))
        .withColumn("consistency_admitted", ~F.col("_w") & ~F.col("_m"))
        .withColumn("count_consistency_checked", F.col("consistency_admitted") & F.coalesce(good, F.lit(False)) & F.col("W").isNotNull())
        .withColumn("status", F.when(F.col("_w"), "COUNT-MISMATCH").otherwise(F.col("status")))
        .drop("_w", "_m")
    )


def _allowed() -> Column:
    memory = F.col("metric").startswith("PeakMemory") | F.col("metric").isin("InputMemory", "BaselineMemory", "ProcessMaxRSS", "MemoryAfterPrepare")
    task = F.when(F.col("metric") == "CountOnlyTime", "count-only").when(F.col("metric") == "PreparedQueryTime", "prepared-query").otherwise("oneshot")
    return (F.col("measurement_mode") == F.when(memory, "memory").otherwise("time")) & (F.col("task") == task)


def metrics_long(reconciled_: DataFrame) -> DataFrame:
    """One row per successful configuration and metric that counts in its mode and task; a second value for one is an error."""
    r = reconciled_.where("status = 'OK' and consistency_admitted")
    long = r.unpivot([*BASE, "data_seed", "measurement_mode", "task"], list(METRICS), "metric", "value").withColumn("value", number(F.col("value"))).where(F.col("value").isNotNull() & _allowed())
    once = F.count("*").over(Window.partitionBy(*BASE, "metric"))
    value = F.when(once == 1, F.col("value")).otherwise(F.raise_error(F.lit("several values for one configuration")).cast("double"))
    return long.withColumn("value", value).select(*BASE, "metric", "data_seed", "value")


def speedups(reconciled_: DataFrame, baselines: Sequence[str] = BASELINES) -> DataFrame:
    """Time of a baseline over time of another algorithm on the same case."""
    case = ["experiment_id", "dataset_id", "workload_id", "x_name", "x_value", "t", "data_seed", "process_repeat_id"]
    time = reconciled_.where("status = 'OK' and consistency_admitted and measurement_mode = 'time' and task = 'oneshot'").withColumn("seconds", number(F.col("OneShotTime"))).where("seconds > 0")
    base = time.where(F.col("algorithm").isin(*baselines)).select(*[F.col(c).alias(f"_{c}") for c in case], F.col("algorithm").alias("baseline"), F.col("seconds").alias("base_seconds"))
    on = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), case, F.col("algorithm") != F.col("baseline"))
    return time.join(base, on).select("experiment_id", "dataset_type", "dataset_id", "sweep", "x_name", "x_value", "t", "level", "data_seed", "algorithm", "baseline", (F.col("base_seconds") / F.col("seconds")).alias("speedup"))


def status_summary(records: DataFrame) -> DataFrame:
    """Number of runs by configuration, mode, task and status."""
    return whole(records).groupBy(*BASE, "measurement_mode", "task", F.coalesce("status", F.lit("MISSING")).alias("status")).agg(F.count("*").cast("bigint").alias("runs"))


def status_maps(summary: DataFrame) -> DataFrame:
    return summary.groupBy(*BASE, "measurement_mode", "task").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "runs")))).alias("statuses"))


def count_consistency(records: DataFrame) -> DataFrame:
    """Distinct counts that successful runs of a workload told."""
    r = whole(records).where(F.col("status").isin(*GOOD) & F.col("W").isNotNull())
    return r.groupBy("dataset_id", "workload_id").agg(F.sort_array(F.collect_set("W")).alias("counts")).select("*", (F.size("counts") == 1).alias("consistent"))


def run_group_consistency(records: DataFrame) -> DataFrame:
    """For each oneshot run group: modes that are missing, fields in which time and memory run differ."""
    r = whole(records).where("task = 'oneshot'")
    of = lambda mode, c: F.max(F.when(F.col("measurement_mode") == mode, F.coalesce(F.col(c).cast("string"), F.lit("<null>"))))
    has = lambda mode: F.max((F.col("measurement_mode") == mode).cast("int")) == 1
    fields = ("W", "status", "output_length")
    g = r.groupBy("run_group_id").agg(has("time").alias("time"), has("memory").alias("memory"), *[of(m, c).alias(f"{m}_{c}") for m in ("time", "memory") for c in fields])
    missing = F.array_compact(F.array(F.when(~F.col("memory"), "memory"), F.when(~F.col("time"), "time")))
    differ = F.array_compact(F.array(*[F.when(F.col("time") & F.col("memory") & (F.col(f"time_{c}") != F.col(f"memory_{c}")), c) for c in fields]))
    return g.select("run_group_id", missing.alias("missing_modes"), differ.alias("mismatched_fields")).withColumn("consistent", (F.size("missing_modes") == 0) & (F.size("mismatched_fields") == 0))


def resource_boundaries(records: DataFrame) -> DataFrame:
    """The last x at which all runs were OK and the first at which one ran out of time or memory."""
    r = whole(records).where("task = 'oneshot'").withColumn("x", number(F.col("x_value"))).where("x is not null")
    key = ["experiment_id", "algorithm", "measurement_mode"]
    at = r.groupBy(*key, "x").agg(F.min((F.col("status") == "OK").cast("int")).alias("fine"), F.max(F.col("status").isin(*EXHAUSTED).cast("int")).alias("out"))
    return at.groupBy(*key).agg(F.max(F.when(F.col("fine") == 1, F.col("x"))).alias("last_successful_x"), F.min(F.when(F.col("out") == 1, F.col("x"))).alias("first_resource_failure_x"))


def not_done(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned runs without a record of their group and mode."""
    return planned.join(done.select("run_group_id", "measurement_mode"), ["run_group_id", "measurement_mode"], "left_anti")


def throughput(records: DataFrame) -> DataFrame:
    """Samples per second of the query phase."""
    return whole(records).where("status = 'OK' and QueryTime > 0").select(*BASE, (F.col("t") / F.col("QueryTime")).alias("samples_per_second"))


@dataclass(frozen=True)
class RunReport:
    """All sections over one set of records."""

    records: DataFrame

    @cached_property
    def reconciled(self) -> DataFrame:
        return reconciled(self.records)

    def sections(self) -> dict[str, DataFrame]:
        r = self.reconciled
        return {
            "preflight": preflight(self.records), "metrics": metrics_long(r), "speedups": speedups(r), "statuses": status_maps(status_summary(r)), "count_consistency": count_consistency(self.records),
            "run_group_consistency": run_group_consistency(r), "resource_boundaries": resource_boundaries(r),
        }
