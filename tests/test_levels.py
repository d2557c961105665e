"""Rank/select tables, ranges by canonical nodes, hot groups and owners that meet everything, against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from boxloom.operators import decompose, levels, prefix, ranges, samplers
from boxloom.operators.boxes import BoxJoin


@pytest.mark.parametrize("n,rows", [(1, 1 << 20), (16, 1 << 20), (17, 9), (300, 50)])
def test_levels(spark, n, rows):
    rnd = random.Random(n)
    v = rnd.sample(range(n), n)
    table = levels.Levels(spark.createDataFrame(list(enumerate(v)), "pos long, val long"), rows)
    assert table.height == {1: 1, 16: 1, 17: 2, 300: 3}[n]
    asked = [(i, rnd.randint(0, n), rnd.randint(0, n + 1)) for i in range(60)] + [(60, n, n), (61, 0, 0)]
    for r in table.below(spark.createDataFrame(asked, "id long, first long, value long")).collect():
        assert r["n"] == sum(x < r["value"] for x in v[: r["first"]])
    asked = [(i, a, b, rnd.randrange(b - a)) for i in range(60) for a, b in [sorted((rnd.randint(0, n), rnd.randint(0, n)))] if a < b] + [(99, 0, n, n - 1)]
    for r in table.kth(spark.createDataFrame(asked, "id long, first long, last long, k long")).collect():
        assert r["value"] == sorted(v[r["first"] : r["last"]])[r["k"]]


def test_running_sums_in_ranges_and_hot_groups(spark):
    rows = [(i, i % 3 if i > 120 else 1, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g long, v long")
    for before in (True, False):
        want = {}
        for i, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
            want[i] = sum(x[0] for x in rows if (x[2], x[0]) < (v, i)) + (0 if before else i)
        got = prefix.running(df, ["v", "id"], {"s": F.col("id")}, rows=7, before=before).collect()
        assert {r["id"]: r["s"] for r in got} == want
        hot = prefix.hot_groups(df, ["g"], 50)
        assert [r["g"] for r in hot.collect()] == [1]
        got = prefix.segmented(df, ["g"], ["v", "id"], {"s": F.col("id")}, hot, rows=20, before=before).collect()
        assert {r["id"]: r["s"] for r in got} == {i: sum(x[0] for x in rows if x[1] == g and (x[2], x[0]) < (v, i)) + (0 if before else i) for i, g, v in rows}
    assert prefix.hot_groups(df, ["g"], 500) is None
    # rows of one first key are split: no range has much more than its share
    same = prefix.in_ranges(spark.range(1000).select(F.lit(1).alias("x"), "id"), ["x"], 10).groupBy("range_no").count().collect()
    assert len(same) == 10 and max(r["count"] for r in same) < 250


def points_and_ranges(spark, d, n=60, asked=25):
    rnd = random.Random(d)
    pts = [(i, *[rnd.choice([float(rnd.randint(0, 9)), -0.0, 0.0]) for _ in range(d)]) for i in range(n)]
    some = lambda: rnd.choice([None, float(rnd.randint(-1, 10)), float(rnd.randint(0, 9))])
    qs = [(q, *[x for _ in range(d) for x in (some(), some(), rnd.random() < 0.5, rnd.choice([True, False, None]))]) for q in range(asked)]
    qs.append((asked, *[None, None, True, True] * d))  # all points
    qs.append((asked + 1, *[3.0, 3.0, False, False] * d))
    p = spark.createDataFrame(pts, "id long, " + ", ".join(f"x{j} double" for j in range(d)))
    q = spark.createDataFrame(qs, "qid long, " + ", ".join(f"lo{j} double, hi{j} double, lo{j}_strict boolean, hi{j}_strict boolean" for j in range(d)))

    def inside(x, r):
        for j in range(d):
            lo, hi, ls, hs = r[1 + 4 * j : 5 + 4 * j]
            ls, hs = ls is None or ls, hs is None or hs
            if lo is not None and not (x[1 + j] > lo or (x[1 + j] == lo and not ls)):
                return False
            if hi is not None and not (x[1 + j] < hi or (x[1 + j] == hi and not hs)):
                return False
        return True

    return p, q, {r[0]: [x for x in pts if inside(x, r)] for r in qs}


@pytest.mark.parametrize("d", [1, 2, 3])
def test_range_counts(spark, d):
    p, q, want = points_and_ranges(spark, d)
    got = ranges.range_count(p, q, d)
    assert {r["qid"]: r["n"] for r in got.collect()} == {k: len(v) for k, v in want.items()}
    assert len(want[25]) == 60
    assert {r["n"] for r in ranges.range_count(p.limit(0), q, d).collect()} == {0} and ranges.range_count(p, q.limit(0), d).count() == 0


def rows_shuffled(spark, df):
    """Rows that exchanges wrote while df ran, by its plan's metrics."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if name == "Exchange":
                total += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_range_counts_list_no_match(spark):
    """Ranges of all points shuffle as many rows as ranges of one."""
    p = spark.range(2000).selectExpr("id", "cast(id as double) as x0", "cast((id * 7919) % 2000 as double) as x1")
    q = lambda hi: spark.range(20).select(F.col("id").alias("qid"), *[c for j in (0, 1) for c in (F.lit(0.0).alias(f"lo{j}"), F.lit(hi).alias(f"hi{j}"), F.lit(False).alias(f"lo{j}_strict"), F.lit(False).alias(f"hi{j}_strict"))])
    few, many = (ranges.Ranges(p, q(hi), 2).counts() for hi in (3.0, 5000.0))
    assert sum(r["n"] for r in many.collect()) == 40_000
    assert rows_shuffled(spark, many) <= rows_shuffled(spark, few) + 400


def test_range_counts_of_three_axes_copy_no_point_to_nodes(spark, monkeypatch):
    from boxloom.operators import dominance, prefix, storage

    rows = []
    for module in (ranges, dominance, prefix):
        monkeypatch.setattr(module, "settled", lambda df: rows.append((out := storage.settled(df)).count()) or out)
    p = spark.range(2000).selectExpr("id", *[f"cast((id * {m}) % 2000 as double) as x{j}" for j, m in enumerate((1, 7919, 104729))])
    q = spark.range(20).select(F.col("id").alias("qid"), *[c for j in range(3) for c in (F.lit(10.0 if j else None).cast("double").alias(f"lo{j}"), F.lit(1900.0).alias(f"hi{j}"), F.lit(True).alias(f"lo{j}_strict"), F.lit(False).alias(f"hi{j}_strict"))])
    want = p.where("x0 <= 1900 and x1 > 10 and x1 <= 1900 and x2 > 10 and x2 <= 1900").count()
    assert {r["n"] for r in ranges.range_count(p, q, 3).collect()} == {want} and sum(rows) < 5 * 2020


def test_range_draws(spark):
    p, q, want = points_and_ranges(spark, 2)
    got = ranges.range_draws(p, q, 2, 40, "s").collect()
    assert collections.Counter(r["qid"] for r in got) == {k: 40 for k, v in want.items() if v}
    assert all(r["id"] in {x[0] for x in want[r["qid"]]} for r in got)
    hot = ranges.range_draws(p, q.where("qid = 25"), 2, 6000, "s")
    n = collections.Counter(r["id"] for r in hot.collect())
    assert len(n) == 60 and 60 < min(n.values()) and max(n.values()) < 150
    assert sorted(hot.collect()) == sorted(ranges.range_draws(p.repartition(3), q.where("qid = 25"), 2, 6000, "s").collect())
    deep, deep_q, deep_want = points_and_ranges(spark, 3)
    drawn = ranges.range_draws(deep, deep_q, 3, 20, "s").collect()
    assert len(drawn) == 20 * sum(bool(v) for v in deep_want.values()) and all(r["id"] in {x[0] for x in deep_want[r["qid"]]} for r in drawn)


def test_active_counts(spark):
    rnd = random.Random(5)
    log = [(s, rnd.randrange(12), rnd.choice([1, -1, 1])) for s in range(80)]
    pts = [(i, float(i % 5)) for i in range(12)]
    asked = [(k, rnd.randrange(-1, 85), float(rnd.randint(0, 3)), None if k % 4 == 0 else 4.0, k % 2 == 0, True) for k in range(30)]
    q = spark.createDataFrame(asked, "qid long, seq long, lo0 double, hi0 double, lo0_strict boolean, hi0_strict boolean")
    got = ranges.active_range_count(spark.createDataFrame(pts, "id long, x0 double"), spark.createDataFrame(log, "seq long, id long, delta int"), q, 1).collect()
    for r in got:
        _, seq, lo, hi, strict, _ = asked[r["qid"]]
        last = {i: delta for s, i, delta in log if s <= seq}
        assert r["n"] == sum(last.get(i) == 1 and (x > lo or (x == lo and not strict)) and (hi is None or x < hi) for i, x in pts)
    assert len(got) == 30


def relation(spark, rows, d):
    return spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{e}{j} bigint" for e in "lu" for j in range(d)))


@pytest.mark.parametrize("d", [1, 2])
def test_boxes_that_meet_everything(spark, d, monkeypatch):
    """Half of a side covers all: groups are cut, rows stay within n log n, and draws of one owner list nothing."""
    rnd = random.Random(d)
    small = lambda n, base: [(base + i, *(lo := [rnd.randint(0, 90) for _ in range(d)]), *[x + rnd.randint(1, 6) for x in lo]) for i in range(n)]
    r = [(i, *[-5] * d, *[200] * d) for i in range(20)] + small(20, 100)
    s = small(60, 1000)
    j = BoxJoin(relation(spark, r, d), relation(spark, s, d))
    want = {(a[0], b[0]) for a in r for b in s if all(a[1 + k] < b[1 + d + k] and b[1 + k] < a[1 + d + k] for k in range(d))}
    blocks, lists = decompose.atoms(j, rows=10)
    assert decompose.total(blocks).first()["w"] == len(want)
    got = decompose.entries(blocks, lists, rows=10).groupBy("owner_id").agg(F.sum("weight").alias("w")).collect()
    assert {x["owner_id"]: x["w"] for x in got} == collections.Counter(a for a, _ in want)
    if d == 2:
        listed = decompose.grouped(j).count()
        assert listed <= (len(r) + len(s)) * 4 * (decompose.height_of(j) + 1)
    for kind in ("sweep", "lifted"):
        sampler = samplers.make_sampler(kind, j, "5e" * 32)
        assert sampler.count() == len(want)
        drawn = [(x["r_id"], x["s_id"]) for x in sampler.sample(6 * len(want)).collect()]
        assert len(drawn) == 6 * len(want) and set(drawn) <= want and len(set(drawn)) > 0.98 * len(want)
        assert max(collections.Counter(drawn).values()) < 26


@pytest.mark.parametrize("d", [1, 2])
def test_quotas_of_replay(spark, d):
    rnd = random.Random(3)
    some = lambda n, base: [(base + i, *(lo := [rnd.randint(0, 60) for _ in range(d)]), *[x + rnd.randint(1, 20) for x in lo]) for i in range(n)]
    sampler = samplers.make_sampler("replay", BoxJoin(relation(spark, some(30, 0), d), relation(spark, some(40, 100), d)), "0e" * 32)
    sampler.RUN = 2
    assert not isinstance(sampler, samplers.Compiled)
    rows = sampler.quotas(3000).collect()
    by_level = collections.defaultdict(lambda: [0, 0])
    for x in rows:
        by_level[x["level"]][0] += x["weight"]
        by_level[x["level"]][1] += x["quota"]
    assert set(map(tuple, by_level.values())) == {(sampler.count(), 3000)} and len(by_level) > 2
    for x in rows:
        assert abs(x["quota"] - 3000 * x["weight"] / sampler.count()) < 6 * (3000 * x["weight"] / sampler.count()) ** 0.5 + 3
