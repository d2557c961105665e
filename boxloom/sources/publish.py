"""Publishing run records in two phases: staged records are checked and reconciled, written as a new version, then made current at once.

A published set is a folder of versions and a file CURRENT that names one of them. Readers follow CURRENT, which is replaced by
a rename, so they see the version before or the one after, never a part. Versions stay, so a set can be rolled back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records
from .runs import append_runs, read_runs

#: Columns a published set is sorted by.
ORDER = ("experiment_id", "dataset_id", "workload_id", "t", "task", "algorithm", "measurement_mode", "run_group_id")


class PublishError(ValueError):
    """Staged records may not be published; they stay where they are."""


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _hadoop(spark, path)
    return fs.exists(at)


def staging(out: str) -> str:
    return out.rstrip("/") + ".partial"


def stage(rows: DataFrame, out: str) -> None:
    """Appends records to those staged for `out`."""
    append_runs(rows, staging(out))


def versions(spark: SparkSession, out: str) -> list[str]:
    """Names of the complete versions, oldest first."""
    at, fs = _hadoop(spark, out)
    found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(v for v in found if v.startswith("v") and exists(spark, f"{out}/{v}/_SUCCESS"))


def current(spark: SparkSession, out: str) -> str | None:
    at, fs = _hadoop(spark, f"{out}/CURRENT")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _point(spark: SparkSession, out: str, version: str) -> None:
    """Makes a version current: a new file takes CURRENT's place by one rename."""
    new, fs = _hadoop(spark, f"{out}/.CURRENT-{version}")
    stream = fs.create(new, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{out}/CURRENT"), how)


def check(staged: DataFrame) -> DataFrame:
    """The records reconciled, or PublishError with the first violations of the checks or the first runs that disagree."""
    broken = records.preflight(staged).limit(5).collect()
    if broken:
        raise PublishError("preflight: " + "; ".join(f"{b['rule']} {b['key']}: {b['found']}" for b in broken))
    found = records.reconciled(staged)
    odd = found.where(~F.col("consistency_admitted")).select("workload_id", "algorithm", "measurement_mode", "status").limit(5).collect()
    if odd:
        raise PublishError("runs disagree: " + "; ".join("/".join(str(x) for x in o) for o in odd))
    return found


def finalize(spark: SparkSession, out: str) -> str:
    """Publishes what is staged for `out` and returns its version; staged records go once they are current.

    If it ends early, CURRENT names the version before and the staged records are still there, so it can be called again. An
    empty stage is an error. Two that publish at once can't take the same version: the second one's claim fails.
    """
    source = staging(out)
    if not exists(spark, source):
        raise PublishError(f"nothing is staged in {source}")
    staged = read_runs(spark, source)
    if staged.isEmpty():
        raise PublishError(f"{source} has no record")
    found = check(staged)
    at, fs = _hadoop(spark, out)
    taken = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    version = f"v{max([int(v[1:7]) for v in taken if v[:1] == 'v' and v[1:7].isdigit()], default=0) + 1:06d}"
    claim, _ = _hadoop(spark, f"{out}/{version}.claim")
    fs.create(claim, False).close()  # fails if it is there
    found.orderBy(*[F.col(c).asc_nulls_first() for c in ORDER]).write.json(f"{out}/{version}")
    _point(spark, out, version)
    old, _ = _hadoop(spark, source)
    fs.delete(old, True)
    return version


def published(spark: SparkSession, out: str) -> DataFrame:
    """The current version's records, with the columns that reconciling adds."""
    version = current(spark, out)
    if version is None:
        raise PublishError(f"nothing is published in {out}")
    added = "original_status string, consistency_admitted boolean, count_consistency_checked boolean"
    return spark.read.schema(f"{records.SCHEMA}, {added}").option("mode", "FAILFAST").json(f"{out}/{version}")


def roll_back(spark: SparkSession, out: str) -> str:
    """Makes the version before the current one current."""
    now, all_ = current(spark, out), versions(spark, out)
    earlier = [v for v in all_ if now is not None and v < now]
    if not earlier:
        raise PublishError(f"{out} has no version before {now}")
    _point(spark, out, earlier[-1])
    return earlier[-1]
