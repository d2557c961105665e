"""What the operators of this subpackage share: tables, shared storage, word patterns, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: What a null id is held as, beside a flag: null ids order after every other id, this one included.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, as in tests, one of our own where it is unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="boxloom-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, which clear() deletes."""
    return f"{shared_dir(spark)}/boxloom-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark's file systems have it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def clear(spark: SparkSession) -> None:
    """Deletes what the operators wrote beside their results. Results are lazy: call it once they have been read or written."""
    remove(spark, session_dir(spark))


def settled(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the shared folder: its lineage ends there and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """A column of a DataFrame by its very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(names: Iterable[str]) -> Column:
    """Columns as one struct whose fields have names of its own, so that no column's name can clash on the way."""
    return F.struct(F.lit(True).alias("_"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])


def unpacked(struct: str, names: Iterable[str]) -> list[Column]:
    """The columns that packed() took together, under their own names."""
    return [F.col(f"{struct}.c{i}").alias(c) for i, c in enumerate(names)]


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def order_of(c: Column) -> tuple[Column, Column]:
    """(id, none): an id and whether it is null. Null ids order last, so minima and maxima of the two columns are those of the pair."""
    return F.coalesce(c.cast("long"), F.lit(LAST_ID)).alias("id"), c.isNull().alias("none")


def given(id: Column, none: Column) -> Column:
    """The id that order_of() took apart."""
    return F.when(~none, id)


def later(id: Column, none: Column, least: Column, least_none: Column) -> Column:
    """Whether an id orders after another one."""
    return (id > least) | ((id == least) & none & ~least_none)


def text_key(text: Column) -> Column:
    """What says that two texts are the same: 128 bits of the SHA-256 of the UTF-8 bytes; null is the empty text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def arrow_batches(spark: SparkSession, rows: int = 500, mb: int = 1) -> None:
    """Bounds the Arrow batches that Python tasks get, so that long texts can't fill a worker's memory.

    The bounds are settings of the session, read when a plan runs. They are only ever lowered, so that one operator never
    widens the batches of another one whose plan is still to run.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", mb << 20)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(f"spark.sql.execution.arrow.{name}").lower())
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def groups_of(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows of equal `key` (an int column, sorted within the partition), as one table each.

    Holds one group and one batch; callers bound the size of a group.
    """
    held: list[pa.Table] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(keys)]
        part = pa.Table.from_batches([batch])
        for a, b in zip(bounds, bounds[1:]):
            if held and keys[a] != at:
                yield pa.concat_tables(held)
                held = []
            at = keys[a]
            held.append(part.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def components(edges: DataFrame, settle: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """(node, component) for each node of `edges` (columns a, b of one type with an order); component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges are stars. Every step is two
    shuffles over at most as many edges as before; each round ends in a reliable checkpoint. Joins are many to one, so
    AQE can split a hub's partition.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    stamp = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    was, state = None, stamp(now)
    while state != was:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = settle(small.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        was, state = state, stamp(now)
    roots = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return roots.unionAll(roots.select(F.col("component").alias("node"), "component").distinct())
