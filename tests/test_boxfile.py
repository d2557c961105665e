"""The box file's parallel writer and its zone maps."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull, LessThan

from boxloom.operators.boxes import BoxJoin
from boxloom.sources import boxfile


def some(spark, n, step=10, base=0):
    return spark.range(n).select((F.col("id") + base).alias("id"), (F.col("id") * step).alias("l0"), F.lit(0).cast("long").alias("l1"), (F.col("id") * step + 5).alias("u0"), F.lit(3).cast("long").alias("u1"))


def test_tasks_write_their_own_ranges(spark, tmp_path):
    join = BoxJoin(some(spark, 5000).repartition(7), some(spark, 1234, 3, 10**6).repartition(3))
    path = str(tmp_path / "many.bin")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that small partitions aren't put together
    try:
        manifest = boxfile.save(join, path, {"from": "test"})
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(manifest["ranges"]) > 3 and manifest["metadata"] == {"from": "test"}
    assert sum(x["rows"] for x in manifest["ranges"]) == 6234
    assert manifest["payload_sha256"] == boxfile.check(path).sha256.hex()
    back = boxfile.load(spark, path)
    assert sorted(back.r.collect()) == sorted(join.r.collect()) and sorted(back.s.collect()) == sorted(join.s.collect())
    again = boxfile.save(BoxJoin(join.r.repartition(2), join.s), str(tmp_path / "again.bin"))
    assert again["payload_sha256"] == manifest["payload_sha256"]
    assert boxfile.save(BoxJoin(join.r.limit(0), join.s.limit(0)), str(tmp_path / "none.bin"))["n_r"] == 0
    assert boxfile.load(spark, str(tmp_path / "none.bin")).r.count() == 0


def batch(side, first, n):
    i = np.arange(first, first + n)
    return pa.RecordBatch.from_pydict({"side": np.full(n, side, np.int32), "place": i, "id": i + 100 * side, "l0": i * 2, "u0": i * 2 + 1})


def test_a_lost_task_is_written_again(tmp_path):
    path = str(tmp_path / "x.bin")
    writer = boxfile.BoxFileWriter(path, "int64", 1, (10, 5), {})
    first = writer.write(iter([batch(0, 0, 4)]))
    writer.write(iter([batch(0, 4, 3)]))  # its executor is lost after half of its rows
    second = writer.write(iter([batch(0, 4, 3), batch(0, 7, 3), batch(1, 0, 5)]))
    with pytest.raises(boxfile.FormatError, match="missing"):
        writer.commit([first, None])
    with pytest.raises(boxfile.FormatError, match="twice"):
        writer.commit([first, first, second])
    writer.commit([first, second])
    assert boxfile.check(path).n_r == 10
    other = boxfile.BoxFileWriter(path, "int64", 1, (1, 1), {})
    other.abort([])
    assert boxfile.check(path).n_r == 10 and not (tmp_path / "x.bin.tmp").exists()  # the old file stays


def test_zone_maps_prune(spark, tmp_path):
    path = str(tmp_path / "z.bin")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        boxfile.save(BoxJoin(some(spark, 4000), some(spark, 10)), path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    with open(path + ".manifest.json") as f:
        ranges = json.load(f)["ranges"]
    header = boxfile.check(path)
    read = lambda *filters: (lambda x: (list(x.pushFilters(list(filters))), x.partitions())[1])(boxfile.PruningReader(path, header, [0], ranges))
    every = read()
    assert len(every) == sum(x["side"] == 0 for x in ranges) > 2 and sum(x.rows for x in every) == 4000
    assert len(read(LessThan(("l0",), 50))) == 1 and len(read(GreaterThan(("id",), 3998))) == 1 and len(read(EqualTo(("u0",), 5))) == 1
    assert [x.rows for x in read(GreaterThan(("l0",), 10**9))] == [0]
    assert len(read(IsNull(("l0",)))) == len(every)
    assert sum(x.rows for x in boxfile.BoxFileReader(path, header, [0], []).partitions()) == 4000  # without statistics all is read
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(boxfile.BoxFileSource)
        got = spark.read.format("boxes").option("side", "r").option("prune", "true").load(path).where("l0 >= 39000 and id < 3950")
        assert sorted(r["id"] for r in got.collect()) == list(range(3900, 3950)) and got.rdd.getNumPartitions() < len(every)
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
