"""Collections of Parquet files with a manifest: a row per file with its size, rows and fingerprint, verified by one aggregate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fingerprints import fingerprints, shared

_FILE = ("collection", "file", "bytes")


def read_parts(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files as one table, columns by name; one that a file lacks is null there."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def write_collections(parts: Mapping[str, DataFrame], folder: str, key: str = "id") -> DataFrame:
    """Writes each table to folder/name in zstd, then the manifest of what is there to folder/manifest; returns it.

    The manifest comes last, so a folder without one is not complete. Names must not be `manifest`.
    """
    if "manifest" in parts:
        raise ValueError("a collection can't be named manifest")
    spark = next(iter(parts.values())).sparkSession
    for name, df in parts.items():
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    _files(spark, folder, sorted(parts), key).write.json(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("collection string, file string, bytes bigint, rows bigint, fingerprint string, key string").json(f"{folder}/manifest")


def _files(spark: SparkSession, folder: str, names: list[str], key: str) -> DataFrame:
    """(collection, file, bytes, rows, fingerprint, key): a row per file that has rows, and one without a file per collection, whose fingerprint is that of its keys."""
    keys = shared({n: spark.read.parquet(f"{folder}/{n}") for n in names}, [key])
    out = keys.select("collection", F.lit("").alias("file"), F.lit(0).cast("bigint").alias("bytes"), "rows", "fingerprint", F.lit(key).alias("key"))
    for name in names:
        df = spark.read.parquet(f"{folder}/{name}")
        at = df.select("*", F.lit(name).alias("_collection"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_size").alias("_bytes"))
        by = ["_collection", "_file", "_bytes"]
        found = fingerprints(at, df.columns, by).select(*[F.col(f"_{c}").alias(c) for c in _FILE], "rows", "fingerprint", F.lit(key).alias("key"))
        out = out.unionAll(found)
    return out


def verify(spark: SparkSession, folder: str, same_ids: bool = False) -> DataFrame:
    """(collection, file, problem) of what isn't as the manifest has it: missing, unexpected or changed files; a whole folder gives no row.

    An empty file name stands for a collection's keys: changed, if they aren't those of the manifest, and with `same_ids` "ids
    differ", if they aren't those of the first collection (by name). A file that can't be read is Spark's error.
    """
    told = manifest(spark, folder)
    first = told.where("file = ''").select("collection", "key").orderBy("collection").collect()  # a row per collection
    names, key = [r["collection"] for r in first], first[0]["key"]
    now = _files(spark, folder, names, key)
    a, b = (df.select("collection", "file", F.struct("bytes", "rows", "fingerprint").alias(n)) for df, n in ((told, "told"), (now, "found")))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("told").isNull(), "unexpected").when(F.col("told") != F.col("found"), "changed")
    out = a.join(b, ["collection", "file"], "full").select("collection", "file", problem.alias("problem")).where("problem is not null")
    if same_ids:
        ids = shared({n: spark.read.parquet(f"{folder}/{n}") for n in names}, [key])
        out = out.unionAll(ids.where("not same").select("collection", F.lit(""), F.lit("ids differ")))
    return out
