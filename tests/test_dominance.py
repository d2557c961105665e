"""Counts that form no pair, in many small ranges, against brute force."""

import collections
import random

import pytest

from boxloom.operators import boxes, decompose, dominance, joins, samplers, sweep
from boxloom.operators.boxes import BoxJoin
from boxloom.plans.catalog import QUERIES
from boxloom.plans.fixtures import FIXTURES


def _some(spark, rnd, n, base, d, kind):
    lows = [[rnd.randint(0, 8) for _ in range(d)] for _ in range(n)]
    rows = [(base + i, *lo, *[x + rnd.randint(0, 4) for x in lo]) for i, lo in enumerate(lows)]
    rows = [(r[0], *map(float, r[1:])) if kind == "double" else r for r in rows]
    return rows, spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{e}{j} {kind}" for e in "lu" for j in range(d)))


@pytest.mark.parametrize("d, kind, rows", [(1, "bigint", 1 << 20), (2, "bigint", 1 << 20), (2, "double", 40), (2, "bigint", 7)])
def test_counts_of_pairs_that_are_not_formed(spark, monkeypatch, d, kind, rows):
    rnd = random.Random(rows + d)
    r, rdf = _some(spark, rnd, 40, 0, d, kind)
    s, sdf = _some(spark, rnd, 30, 100, d, kind)
    full = lambda b: all(b[1 + k] < b[1 + d + k] for k in range(d))
    pairs = [(a, b) for a in r for b in s if full(a) and full(b) and all(a[1 + k] < b[1 + d + k] and b[1 + k] < a[1 + d + k] for k in range(d))]
    counted = dominance.term_counts
    monkeypatch.setattr(dominance, "term_counts", lambda p, q, terms, _=None: counted(p, q, terms, rows))
    monkeypatch.setattr(joins, "grid_pairs", None)  # no pair is listed
    j = BoxJoin(rdf, sdf)
    assert dict(map(tuple, joins.degrees_counted(j).collect())) == collections.Counter(a[0] for a, _ in pairs)
    assert joins.total_counted(j).first()["w"] == len(pairs)
    own = collections.Counter(sum((a[1 + k] <= b[1 + k]) << k for k in range(d)) for a, b in pairs)
    assert dict(map(tuple, joins.ownership_counted(j).collect())) == own
    later = collections.Counter((0, a[0]) if a[1] > b[1] else (1, b[0]) for a, b in pairs)
    assert {(x["side"], x["id"]): x["weight"] for x in sweep.weights(j).collect()} == later


def test_plans_of_counts_hold_no_join_of_boxes(spark, sf_dir):
    """Boxes that all meet are n rows a side and term, not n * n pairs: the only join is that with the table of ranges."""
    j = FIXTURES["evt2_l1"](spark, sf_dir)
    plan = joins.degrees_counted(j)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert boxes.dimension(j.r) == 2


def test_strip_weights_carry_no_box_over_a_border(spark, monkeypatch):
    """Long boxes would be carried into each of many strips."""
    rows = spark.range(40).selectExpr("id", "id as l0", "id as l1", "id + 100 as u0", "id + 1 as u1")
    monkeypatch.setattr(sweep, "strips", None)
    got = sweep.strip_weights(BoxJoin(rows, rows), 2).collect()
    assert sum(x["weight"] for x in got) == 40


@pytest.mark.parametrize("d, kind, chunk", [(3, "bigint", 7), (3, "double", 1 << 15), (4, "double", 12)])
def test_counts_by_tiles(spark, monkeypatch, d, kind, chunk):
    """Three axes and more: chunks that all meet, none meet or are compared, against brute force; no blocks are made."""
    rnd = random.Random(chunk + d)
    r, rdf = _some(spark, rnd, 60, 0, d, kind)
    s, sdf = _some(spark, rnd, 50, 100, d, kind)
    full = lambda b: all(b[1 + k] < b[1 + d + k] for k in range(d))
    pairs = [(a, b) for a in r for b in s if full(a) and full(b) and all(a[1 + k] < b[1 + d + k] and b[1 + k] < a[1 + d + k] for k in range(d))]
    monkeypatch.setattr(dominance, "CHUNK", chunk)
    monkeypatch.setattr(decompose, "grouped", None)
    j = BoxJoin(rdf, sdf)
    later = collections.Counter((0, a[0]) if a[1] > b[1] else (1, b[0]) for a, b in pairs)
    assert {(x["side"], x["id"]): x["weight"] for x in sweep.weights(j).collect()} == later
    anchors = collections.Counter((0, a[0]) if a[d] <= b[d] else (1, b[0]) for a, b in pairs)
    assert {tuple(x)[:2]: x["weight"] for x in decompose.anchors_counted(j).collect()} == anchors and len(pairs) > 2
    assert sweep.weights(BoxJoin(rdf.limit(0), sdf)).count() == 0


@pytest.mark.parametrize("d, kind, chunk", [(1, "bigint", 7), (2, "double", 11), (2, "bigint", 1 << 15), (4, "double", 12)])
def test_totals_by_tiles(spark, monkeypatch, d, kind, chunk):
    """The plain predicate, and the anchors of the decomposition: no pair is formed, no block is made."""
    rnd = random.Random(chunk)
    r, rdf = _some(spark, rnd, 60, 0, d, kind)
    s, sdf = _some(spark, rnd, 50, 100, d, kind)
    full = lambda b: all(b[1 + k] < b[1 + d + k] for k in range(d))
    want = sum(full(a) and full(b) and all(a[1 + k] < b[1 + d + k] and b[1 + k] < a[1 + d + k] for k in range(d)) for a in r for b in s)
    monkeypatch.setattr(dominance, "CHUNK", chunk)
    monkeypatch.setattr(joins, "theta_pairs", None)
    assert joins.theta_total(BoxJoin(rdf, sdf)).first()["w"] == want > 2
    assert joins.theta_total(BoxJoin(rdf.limit(0), sdf)).first()["w"] == 0
    if d > 2:
        monkeypatch.setattr(decompose, "atoms", None)
    assert decompose.total_counted(BoxJoin(rdf, sdf)).first()["w"] == want


def test_theta_counts_pass_one_number_per_tile(spark, sf_dir, monkeypatch):
    """The queries themselves: no nested loop over rows, and tiles that meet whole are a product."""
    monkeypatch.setattr(joins, "theta_pairs", None)
    assert QUERIES["box_theta_join_count_ord1"](spark, sf_dir).first()["w"] == 5297
    monkeypatch.setattr(dominance, "_tile", None)
    rows = spark.range(60).selectExpr("id", "-id - 1 as l0", "id + 1 as u0")
    assert joins.theta_total(BoxJoin(rows, rows), 20).first()["w"] == 3600


def test_tiles_of_chunks_that_all_meet(spark, monkeypatch):
    """Boxes that cover all are counted by their chunks' bounds: no task compares rows."""
    rows = spark.range(60).selectExpr("id", *[f"{e} as {x}{k}" for k in range(3) for x, e in (("l", "-id - 1"), ("u", "id + 1"))])
    monkeypatch.setattr(dominance, "CHUNK", 20)
    monkeypatch.setattr(dominance, "_tile", None)
    got = dominance.weighed(rows, rows, [dominance.overlap(k) for k in range(3)]).collect()
    assert {x["id"]: x["weight"] for x in got} == dict.fromkeys(range(60), 60)


@pytest.mark.parametrize("kind", ["compiled", "sweep", "lifted"])
def test_samples_without_blocks_are_those_with_them(spark, sf_dir, monkeypatch, kind):
    """A few draws list the partners of drawn boxes and make no block; the blocks give the same pairs."""
    j = FIXTURES["part2"](spark, sf_dir)
    with monkeypatch.context() as m:
        m.setattr(decompose, "grouped", None)
        got = sorted(map(tuple, samplers.make_sampler(kind, j, "5e" * 32).sample(40).collect()))
    found = samplers._Anchored._found
    monkeypatch.setattr(samplers._Anchored, "_found", lambda self, drawn, w: (found(self, drawn, w)[0], False))
    assert got == sorted(map(tuple, samplers.make_sampler(kind, j, "5e" * 32).sample(40).collect())) and len(got) == 40
