"""Pairs in tiles against brute force, and where they are made."""

import random

import pytest
from pyspark.sql import functions as F

from boxloom.operators import joins, ranges, sweep, tiles, validation
from boxloom.operators.boxes import BoxJoin
from boxloom.plans.catalog import QUERIES
from boxloom.plans.fixtures import FIXTURES


def _some(spark, rnd, n, base, d, kind, far):
    """Boxes with ties, some empty, one so large that it meets nearly all, many equal ones."""
    lows = [[rnd.randint(-8, 8) for _ in range(d)] for _ in range(n - 12)]
    rows = [(base + i, *lo, *[x + rnd.randint(0, 4) for x in lo]) for i, lo in enumerate(lows)]
    rows += [(base + n - 12, *[-far] * d, *[far] * d), *[(base + n - 11 + i, *[1] * d, *[3] * d) for i in range(11)]]
    rows = [(r[0], *map(float, r[1:])) if kind == "double" else r for r in rows]
    return rows, spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{e}{j} {kind}" for e in "lu" for j in range(d)))


@pytest.mark.parametrize("d, kind, far, work", [(1, "bigint", 2**63 - 1, 64), (1, "double", 1e9, 1 << 24), (2, "bigint", 50, 64), (2, "double", float("inf"), 200), (3, "double", 9.5, 64)])
def test_pairs_by_tiles(spark, monkeypatch, d, kind, far, work):
    rnd = random.Random(d)
    r, rdf = _some(spark, rnd, 60, 0, d, kind, far)
    s, sdf = _some(spark, rnd, 50, 100, d, kind, far)
    full = lambda b: all(b[1 + k] < b[1 + d + k] for k in range(d))
    want = sorted((a[0], b[0]) for a in r for b in s if full(a) and full(b) and all(a[1 + k] < b[1 + d + k] and b[1 + k] < a[1 + d + k] for k in range(d)))
    monkeypatch.setattr(tiles, "WORK", work)
    monkeypatch.setattr(tiles, "LEAST", 2)
    j = BoxJoin(rdf, sdf)
    met = tiles.overlapping(j, 5)
    assert sorted(map(tuple, met.select("r_id", "s_id").collect())) == want and len(want) > 50
    assert {f"{x}_{c}" for x in "rs" for c in rdf.columns} == set(met.columns)
    assert sorted(map(tuple, sweep.strip_pairs(j, 9).collect())) == want
    assert tiles.overlapping(BoxJoin(rdf.limit(0), sdf)).count() == 0


def test_dense_pairs_are_made_in_many_tasks(spark, sf_dir, monkeypatch):
    """A table of one file, of which a join by cells makes all pairs in as few tasks as the file has parts."""
    monkeypatch.setattr(tiles, "WORK", 1024)
    monkeypatch.setattr(joins, "grid_pairs", None)
    found = QUERIES["box_join_pairs_ord1"](spark, sf_dir).groupBy(F.spark_partition_id()).count().collect()
    sizes = [x["count"] for x in found]
    assert sum(sizes) == 5297 and len(sizes) >= 8 and max(sizes) < 5297 / 3


def test_frequencies_shuffle_no_pair(spark, sf_dir):
    joined = tiles.overlapping(FIXTURES["part2"](spark, sf_dir)).select("r_id", "s_id")
    pairs = sorted(map(tuple, joined.collect()))
    sample = spark.createDataFrame([(0, *pairs[3]), (1, *pairs[3]), (2, *pairs[0])], "pos bigint, r_id bigint, s_id bigint")
    found = validation.frequencies(joined, sample)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert sorted(map(tuple, found.collect())) == [(*p, {0: 1, 3: 2}.get(i, 0)) for i, p in enumerate(pairs)]


def test_strips_of_many_borders(spark):
    """Strips by halving: the first is that of the start, the last the last that begins before the end."""
    rows = spark.range(400).selectExpr("id", "id * 3 % 97 as l0", "id * 3 % 97 + id % 9 + 1 as u0")
    found = sweep.strips(BoxJoin(rows, rows), 8).where("side = 0").collect()
    starts = {x["id"]: x["strip"] for x in found if not x["carried"]}
    first = {}
    for x in found:
        if not x["carried"]:
            first[x["strip"]] = min(first.get(x["strip"], x["l0"]), x["l0"])
    assert len(starts) == 400 and len(first) > 30
    assert all(x["strip"] > starts[x["id"]] and x["u0"] > first[x["strip"]] for x in found if x["carried"])


def test_active_points_are_listed_in_many_tasks(spark, monkeypatch):
    """Every moment with every active point, against a loop; the pairs are made where the arrays meet."""
    monkeypatch.setattr(tiles, "WORK", 512)
    rnd = random.Random(3)
    log, state, want = [], {}, []
    for seq in range(600):
        i = rnd.randint(0, 39)
        state[i] = -state.get(i, -1)
        log.append((seq, i, state[i]))
        if seq % 7 == 0:
            want += [(seq, x) for x, on in state.items() if on == 1]
    moments = spark.createDataFrame([(q, q) for q in range(0, 600, 7)], "qid bigint, seq bigint")
    found = ranges.active_at(spark.createDataFrame(log, "seq bigint, id bigint, delta int"), moments)
    rows = found.select("qid", "id", F.spark_partition_id()).collect()
    assert sorted((x[0], x[1]) for x in rows) == sorted(want)
    assert len({x[2] for x in rows}) >= 3
