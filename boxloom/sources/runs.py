"""Reading and writing run records and reports: JSON lines in, JSON lines, CSV and JSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records


def read_runs(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of JSON-line files by the fixed schema; a line that isn't an object is an error, blank lines are skipped."""
    return spark.read.schema(records.SCHEMA).option("mode", "FAILFAST").json(list(paths))


def append_runs(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(report: records.RunReport, folder: str) -> None:
    """Each section as JSON lines in order of its columns (but maps), the metrics also as CSV with a header and nested values as JSON."""
    for name, df in report.sections().items():
        df.orderBy(*[F.col(c).asc_nulls_first() for c, kind in df.dtypes if not kind.startswith("map")]).write.mode("overwrite").json(f"{folder}/{name}")
    write_csv(report.sections()["metrics"], f"{folder}/metrics_csv")


def write_csv(df: DataFrame, path: str) -> None:
    """Columns in order of name; arrays, maps and structs as JSON."""
    nested = ("array", "map", "struct")
    columns = [(F.to_json(c) if kind.startswith(nested) else F.col(c)).alias(c) for c, kind in sorted(df.dtypes)]
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)
