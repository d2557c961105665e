"""The generator's certificate: enclosures against exact rationals, moments, and the same result in tasks as on the driver."""

import math
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxloom.operators import generator as g

LENGTH = st.one_of(st.floats(5e-324, 1, exclude_max=True), st.floats(-700, -1e-12).map(math.exp), st.floats(0.49999, 0.50001))


def _exact(a: float, b: float) -> Fraction:
    a, b = Fraction(a), Fraction(b)
    return Fraction(1) if a + b >= 1 else 1 - (1 - a - b) ** 2 / ((1 - a) * (1 - b))


@settings(max_examples=400, deadline=None)
@given(LENGTH, LENGTH)
def test_enclosure_holds_the_exact_chance(a, b):
    for x, y in ((a, b), (a, 1 - a), (a, math.nextafter(1 - a, 0))):
        if not 0 < y < 1:
            continue
        low, high = (float(v[0]) for v in g.overlap_enclosure(np.array([x]), np.array([y])))
        exact = _exact(x, y)
        assert Fraction(low) <= exact <= Fraction(high) and 0 <= low <= high <= 1
        if x + y < 0.9 and min(x, y) > 1e-290:
            assert high - low <= 1e-14 * high


@settings(max_examples=200, deadline=None)
@given(st.floats(-2000, -1e-6), st.floats(-2000, -1e-6))
def test_log_kernel_against_200_digits(u, v):
    with localcontext() as c:
        c.prec = 1200
        a, b = Decimal(u).exp(), Decimal(v).exp()
        p = Decimal(1) if a + b >= 1 else 1 - (1 - a - b) ** 2 / ((1 - a) * (1 - b))
        c.prec = 200
        want = float(p.ln())
    got = float(g.log_overlap_probability(np.array([u]), np.array([v]))[0])
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_log_kernel_without_length():
    assert np.isneginf(g.log_overlap_probability(np.array([-np.inf, -1.0]), np.array([-1.0, -np.inf]))).all()


def test_products_and_sums_are_enclosed():
    config = g.BoxConfig(50, 70, 3, 1.5, cv=0.7, sigma=0.3)
    drawn = g._pairs(config, 5, "test", 0, 60)
    found = g.enclosures(1.0, drawn, config)
    a, b = g._sides(1.0, drawn[0], drawn[1], 50, config), g._sides(1.0, drawn[2], drawn[3], 70, config)
    exact = [math.prod(_exact(x, y) for x, y in zip(i, j)) for i, j in zip(a.tolist(), b.tolist())]
    assert all(Fraction(lo) <= p <= Fraction(hi) for lo, p, hi in zip(found.low.tolist(), exact, found.high.tolist()))
    parts = [g.Interval(found.low[i : i + 20], found.high[i : i + 20]) for i in (0, 20, 40)]
    for m in (g.Moments.of(found), g.Moments.of(parts[0]).plus(g.Moments.of(parts[1])).plus(g.Moments.of(parts[2]))):
        assert m.n == 60 and Fraction(m.low) <= sum(exact) <= Fraction(m.high) and sum(p * p for p in exact) <= Fraction(m.squares)
        low, high = m.bernstein(1e-6)
        assert 0 <= low <= float(sum(exact) / 60) <= high <= 1


def test_least_double_above():
    for x in (Fraction(1, 3), Fraction(1, 10), Fraction(5, 8), Fraction(-1, 3), Fraction(0)):
        y = g._up(x)
        assert Fraction(y) >= x and (Fraction(y) == x or Fraction(math.nextafter(y, -math.inf)) < x)


@pytest.mark.parametrize("config", [g.BoxConfig(1000, 1000, 2, 5.0), g.BoxConfig(400, 900, 1, 2.0, family="fixed")])
def test_tasks_find_what_the_driver_finds(spark, config):
    here = g.solve(config, 3, batch=8192)
    assert here == g.solve(config, 3, batch=8192, spark=spark) and here.status == "CERTIFIED"
    assert config.alpha * 0.95 <= here.alpha_low <= here.alpha_high <= config.alpha * 1.05
    assert g.solve(config, 3, batch=64, batches=3).status in ("EXHAUSTED", "DISJOINT")


def test_the_density_is_what_was_certified(spark):
    from boxloom.operators import joins

    config = g.BoxConfig(3000, 3000, 2, 4.0)
    coverage = g.solve(config, 11, spark=spark)
    w = joins.count(joins.grid_pairs(g.generate(spark, config, coverage, 11))).first()["w"]
    assert abs(w / 6000 - 4) < 0.4
