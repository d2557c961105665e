"""Draws from ranges by blocks of an order, against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from boxloom.operators import ranges, selection, storage


@pytest.mark.parametrize("d", [1, 2, 3])
def test_draws_are_the_numbered_points(spark, d):
    rnd = random.Random(d)
    n = 50
    axes = [rnd.sample(range(n), n) for _ in range(d)]
    asked = [(q, *[x for _ in range(d) for x in sorted(rnd.sample(range(n + 1), 2))]) for q in range(12)]
    p = spark.createDataFrame([(f"p{i}", i, *[a[i] for a in axes]) for i in range(n)], "id string, at long, " + ", ".join(f"r{j} long" for j in range(d)))
    q = spark.createDataFrame(asked, "qid long, " + ", ".join(f"l{j} long, u{j} long" for j in range(d)))
    inside = {r[0]: [f"p{i}" for i in range(n) if all(r[1 + 2 * j] <= axes[j][i] < r[2 + 2 * j] for j in range(d))] for r in asked}
    whole = selection.drawn(p, q, d, 30, "s", block=n).collect()
    assert {r["qid"] for r in whole} == {k for k, v in inside.items() if v} and all(r["id"] in inside[r["qid"]] for r in whole)
    # blocks and chunks only divide the work
    assert sorted(whole) == sorted(selection.drawn(p, q, d, 30, "s", block=9, chunk=7).collect())
    own = p.withColumn("at", F.col(f"r{d - 1}"))
    assert sorted(selection.drawn(own, q, d, 30, "s", block=n).collect()) == sorted(selection.drawn(own, q, d, 30, "s", axis=d - 1, block=9, chunk=7).collect())


def test_samples_list_no_match(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(selection, "settled", lambda df: rows.append((out := storage.settled(df)).count()) or out)
    p = spark.range(2000).selectExpr("id", "cast(id as double) as x0", "cast((id * 7919) % 2000 as double) as x1")
    q = spark.range(20).select(F.col("id").alias("qid"), *[c for j in (0, 1) for c in (F.lit(None).cast("double").alias(f"lo{j}"), F.lit(5000.0).alias(f"hi{j}"), F.lit(False).alias(f"lo{j}_strict"), F.lit(False).alias(f"hi{j}_strict"))])
    for made in (ranges.range_sample, ranges.range_draws):
        rows.clear()
        assert made(p, q, 2, 5, "s").count() == 100 and sum(rows) <= 2000 + 20 + 20 * selection.BLOCKS + 200
