"""Box joins, decomposition, sweep and samplers on small instances, against brute force."""

import collections
import itertools
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxloom.operators import boxes, decompose, joins, samplers, sweep, validation
from boxloom.operators.boxes import BoxError, BoxJoin
from boxloom.plans import catalog, fixtures


def relation(spark, rows, d, kind="bigint"):
    return spark.createDataFrame([tuple(r) for r in rows], "id bigint, " + ", ".join(f"{e}{j} {kind}" for e in "lu" for j in range(d)))


def brute(r, s, d):
    full = lambda b: all(b[1 + j] < b[1 + d + j] for j in range(d))
    return {(a[0], b[0]) for a in r for b in s if full(a) and full(b) and all(a[1 + j] < b[1 + d + j] and b[1 + j] < a[1 + d + j] for j in range(d))}


CASES = {
    "tiny": (1, "bigint", [(1, 0, 1), (2, 1, 3), (3, 3, 4)], [(10, 1, 2), (11, 2, 3), (12, 3, 4)], 3),
    "touching and equal boxes": (1, "bigint", [(1, 0, 1), (2, 0, 1)], [(3, 0, 1), (4, 1, 2)], 2),
    "doubles and an empty box": (2, "double", [(10, -1.5, 0.0, 2.0, 3.0), (11, 4.0, 1.0, 4.0, 5.0)], [(20, 1.0, 2.5, 5.0, 4.0), (21, 2.0, 0.0, 3.0, 1.0)], 1),
    "empty after filtering": (1, "bigint", [(1, 1, 1)], [(2, 0, 1)], 0),
    "all pairs": (1, "bigint", [(1, 0, 5), (2, 0, 5)], [(3, 0, 5), (4, 0, 5)], 4),
    "extreme integers": (1, "bigint", [(1, -(2**63), 0)], [(2, -1, 2**63 - 1)], 1),
}


@pytest.mark.parametrize("name", CASES)
def test_small_joins(spark, name):
    d, kind, r, s, w = CASES[name]
    j = BoxJoin(relation(spark, r, d, kind), relation(spark, s, d, kind))
    assert {tuple(x) for x in joins.pairs(joins.theta_pairs(j)).collect()} == brute(r, s, d)
    assert decompose.total(decompose.atoms(j)[0]).first()["w"] == w == len(brute(r, s, d))
    if name != "extreme integers":  # cells of such extents overflow, which is an error
        assert {tuple(x) for x in joins.pairs(joins.grid_pairs(j)).collect()} == brute(r, s, d)
    assert sum(x["weight"] for x in sweep.weights(j).collect()) == w


@pytest.mark.parametrize("d", [1, 2, 3])
def test_random_instances_with_ties(spark, d):
    rnd = random.Random(d)
    def some(n, base):
        return [(base + i, *(lo := [rnd.randint(0, 8) for _ in range(d)]), *[x + rnd.randint(0, 4) for x in lo]) for i in range(n)]

    r, s = some(25, 0), some(25, 100)
    j = BoxJoin(relation(spark, r, d), relation(spark, s, d))
    want = brute(r, s, d)
    grid = joins.grid_pairs(j).cache()
    assert sorted(tuple(x) for x in joins.pairs(grid).collect()) == sorted(want)
    for height in (1, 16):
        blocks, lists = decompose.atoms(j, height)
        assert decompose.total(blocks).first()["w"] == len(want)
    assert sum(x["pairs"] for x in joins.ownership_counts(grid, d).collect()) == len(want)
    assert sum(x["degree"] for x in joins.degrees(grid).collect()) == len(want)
    assert sum(x["weight"] for x in sweep.weights(j).collect()) == len(want)
    for starts in (1 << 17, 7):
        assert sorted(tuple(x) for x in sweep.strip_pairs(j, starts).collect()) == sorted(want)
        assert sorted(map(tuple, sweep.strip_weights(j, starts).collect())) == sorted(map(tuple, sweep.weights(j).select("side", "id", "weight").collect()))
    assert sweep.strips(j, 7).select("strip").distinct().count() > 3
    turned = BoxJoin(j.s, j.r)
    assert decompose.total(decompose.atoms(turned)[0]).first()["w"] == len(want)


@pytest.mark.parametrize("kind", samplers.KINDS)
def test_samplers(spark, kind):
    r, s = [(1, 0, 0, 5, 5), (2, 0, 0, 5, 5)], [(3, 0, 1, 5, 2), (4, 1, 0, 5, 5), (5, 9, 9, 10, 10)]
    j = BoxJoin(relation(spark, r, 2), relation(spark, s, 2))
    sampler = samplers.make_sampler(kind, j, "ab" * 32)
    assert sampler.count() == 4 and sampler.status(5) == "OK"
    rows = sampler.sample(4000).collect()
    counts = collections.Counter((x["r_id"], x["s_id"]) for x in rows)
    assert set(counts) == {(1, 3), (1, 4), (2, 3), (2, 4)} and all(850 < n < 1150 for n in counts.values())
    assert sorted(x["pos"] for x in rows) == list(range(4000))
    again = samplers.make_sampler(kind, BoxJoin(j.r.repartition(3), j.s.repartition(2)), "ab" * 32).sample(4000).collect()
    assert sorted(rows) == sorted(again)
    assert sorted(rows) != sorted(sampler.sample(4000, query_id=1).collect())
    assert joins.invalid_pairs(j, sampler.sample(50)).count() == 0
    empty = samplers.make_sampler(kind, BoxJoin(j.r, relation(spark, [(3, 1, 1, 1, 1)], 2)), "00" * 32)
    assert empty.count() == 0 and empty.sample(3).count() == 0 and empty.status(3) == samplers.EMPTY and empty.status(0) == "OK"
    with pytest.raises(ValueError):
        samplers.make_sampler(kind, j, "zz")


def test_report_of_a_uniform_sample(spark):
    j = BoxJoin(relation(spark, [(1, 0, 5), (2, 0, 5)], 1), relation(spark, [(3, 0, 5), (4, 0, 5)], 1))
    report = validation.distribution_report(j, samplers.make_sampler("lifted", j, "cd" * 32).sample(4000), buckets=4)
    row = report.first()
    assert (row["pairs"], row["draws"]) == (4, 4000) and 1e-6 < row["p_pairs"] <= 1 and row["p_steps"] > 1e-6 and abs(row["correlation"]) < 0.1
    first = spark.range(4000).selectExpr("id as pos", "1L as r_id", "3L as s_id")
    bad = validation.distribution_report(j, first, buckets=4)
    reports = report.selectExpr("'w' as workload", "'good' as kind", "p_pairs", "p_steps").unionAll(bad.selectExpr("'w'", "'bad'", "p_pairs", "p_steps"))
    assert {(r["kind"], r["status"]) for r in validation.gate(reports).collect()} == {("good", "PASS"), ("bad", "FAIL")}
    assert abs(validation.chi_square_tail(148.1, 138) - 0.2637) < 2e-3
    assert abs(validation.chi_square_tail(3.841459, 1) - 0.05) < 1e-6


def test_holm(spark):
    p = spark.createDataFrame([("a", 0.001), ("b", 0.004), ("c", 0.2)], "label string, p double")
    assert {x["label"] for x in validation.holm(p).where("rejected").collect()} == {"a", "b"}


def test_all_orders_are_on_a_side(spark, sf_dir):
    for name in ("ord1", "ord_all"):
        j = fixtures.FIXTURES[name](spark, sf_dir)
        assert j.r.count() + j.s.count() == fixtures.read(spark, sf_dir, "orders").count()
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{sf_dir}/orders.parquet'")
    import __spark_entry__

    of = lambda name: [n for n in __spark_entry__.queries() if n.endswith(f"_{name}") or f"_{name}_" in n]
    assert len(of("ord_all")) == len(of("ord1")) - 2 == 21  # two by strips
    for name in ("box_summary_ord_all", "box_ownership_ord_all", "decomposed_count_ord_all", "sweep_weights_ord_all", "box_touch_pairs_ord_all", "sample_ord_all_lifted"):
        assert sorted(map(tuple, catalog.QUERIES[name](spark, sf_dir).collect())) == sorted(con.sql(catalog.SQL[name]).fetchall()), name


def test_guards(spark):
    nan = relation(spark, [(1, float("nan"), 1.0)], 1, "double")
    with pytest.raises(Exception, match="finite"):
        boxes.finite(nan).collect()
    with pytest.raises(Exception, match="empty"):
        boxes.strict(relation(spark, [(1, 2, 2)], 1)).collect()
    with pytest.raises(BoxError):
        BoxJoin(relation(spark, [(1, 2, 2)], 1), relation(spark, [(1, 2, 2, 3, 3)], 2))
    with pytest.raises(BoxError):
        BoxJoin(relation(spark, [(1, 2, 2)], 1), nan)
    assert boxes.repeated_ids(relation(spark, [(1, 2, 3), (1, 2, 4), (2, 0, 1)], 1)).collect()[0]["copies"] == 2
    with pytest.raises(Exception):
        boxes.around(spark.createDataFrame([(1, 2**63 - 5)], "id bigint, x bigint"), "id", ["x"], [100]).collect()
    row = boxes.around(spark.createDataFrame([(1, 10, 20)], "id bigint, x bigint, y bigint"), "id", ["x", "y"], [3, 4]).first()
    assert tuple(row) == (1, 7, 16, 14, 25)


def test_contacts(spark):
    r = relation(spark, [(1, 0, 0, 1, 1)], 2)
    s = relation(spark, [(2, 1, 0, 2, 1), (3, 1, 1, 2, 2), (4, 5, 5, 6, 6)], 2)
    got = {x["contact"]: x["n"] for x in joins.contact_counts(BoxJoin(r, s)).collect()}
    assert (got["x_upper_lower"], got["y_upper_lower"], got["corner"], got["all"]) == (2, 1, 1, 2)
    assert joins.touching_pairs(BoxJoin(r, s)).count() == 2


def test_stabbing(spark):
    spans = spark.createDataFrame([(0, 5, "a"), (5, 9, "b")], "start bigint, end bigint, name string")
    assert joins.stab(spark.createDataFrame([(5,)], "z bigint"), spans).first()["name"] == "b"
    with pytest.raises(Exception, match="exactly one"):
        joins.stab(spark.createDataFrame([(9,)], "z bigint"), spans).collect()


def test_exhaustive_masks(spark):
    """All subsets of four boxes against a few of the other side, as one relation per case in one query."""
    pool = [(0, 2), (1, 3), (2, 2), (0, 4)]
    for r_mask, s_mask in itertools.product((1, 6, 11, 15), (3, 8, 15)):
        r = [(i, *pool[i]) for i in range(4) if r_mask >> i & 1]
        s = [(i, *pool[(i + 2) % 4]) for i in range(4) if s_mask >> i & 1]
        j = BoxJoin(relation(spark, r, 1), relation(spark, s, 1))
        assert decompose.total(decompose.atoms(j)[0]).first()["w"] == len(brute(r, s, 1))


def test_range_prefixes_agree(spark):
    from boxloom.operators.prefix import counts_at, ranked

    df = spark.createDataFrame([(i, (i * 37) % 50) for i in range(200)], "id bigint, x bigint")
    one, many = ranked(df, ["x", "id"]), ranked(df, ["x", "id"], rows=9)
    assert sorted(one.collect()) == sorted(many.collect())
    at = spark.createDataFrame([(k, k % 2 == 0) for k in range(-1, 52)], "x bigint, inclusive boolean")
    for rows in (1 << 20, 7):
        for r in counts_at(df, at, rows=rows).collect():
            assert r["n_below"] == sum((i * 37) % 50 < r["x"] or (r["inclusive"] and (i * 37) % 50 == r["x"]) for i in range(200))


@pytest.mark.parametrize("d, kind", [(1, "bigint"), (2, "bigint"), (2, "double"), (3, "bigint")])
def test_touching_pairs_are_not_compared_with_each_other(spark, d, kind):
    """Each pair once, whichever endpoints it touches at; no exchange holds pairs."""
    rnd = random.Random(d)
    some = lambda base: [(base + i, *(lo := [rnd.randint(0, 5) for _ in range(d)]), *[x + rnd.choice([0, 1, 2, 3, 90]) for x in lo]) for i in range(50)]
    r, s = some(0), some(100)
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{e}{j} bigint" for e in "lu" for j in range(d))).select("id", *[F.col(f"{e}{j}").cast(kind) for e in "lu" for j in range(d)])
    full = lambda b: all(b[1 + k] < b[1 + d + k] for k in range(d))
    closed = lambda a, b: all(a[1 + k] <= b[1 + d + k] and b[1 + k] <= a[1 + d + k] for k in range(d))
    strict = lambda a, b: all(a[1 + k] < b[1 + d + k] and b[1 + k] < a[1 + d + k] for k in range(d))
    want = sorted((a[0], b[0]) for a in r for b in s if full(a) and full(b) and closed(a, b) and not strict(a, b))
    got = joins.touching_pairs(BoxJoin(frame(r), frame(s)))
    assert sorted(map(tuple, got.collect())) == want and want
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_strips_pass_pairs_on_as_they_are_met(monkeypatch):
    """All of 600 boxes overlap: what is held at once is bounded, not a strip's pairs."""
    monkeypatch.setattr(sweep, "OPEN", 64)
    n = 600
    t = pa.table({"side": pa.array([i % 2 for i in range(n)], pa.int32()), "carried": [False] * n, "id": list(range(n)), "l0": [i // 3 for i in range(n)], "u0": [9 * n] * n, "l1": [i * 7 % n for i in range(n)], "u1": [9 * n] * n})
    parts = list(sweep._pass(t, 2, True))
    assert max(x.num_rows for x in parts) <= sweep.STARTS * 64
    assert sorted(p for x in parts for p in zip(*x.to_pydict().values())) == [(i, j) for i in range(0, n, 2) for j in range(1, n, 2)]
