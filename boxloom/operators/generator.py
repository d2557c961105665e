"""Certified synthetic boxes: sides and positions drawn so that the expected join size per box is a given density."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from fractions import Fraction
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..functions.hashing import stable_id
from .boxes import BoxJoin

FAMILIES = ("fixed", "exponential", "lognormal", "normal")
#: Rows of a block; each block of each side and variable has a random stream of its own.
BLOCK = 1 << 16


class CoverageFailure(RuntimeError):
    """No scale gives the density, or it couldn't be certified."""


@dataclass(frozen=True)
class BoxConfig:
    """n_r and n_s boxes in [0, 1)^d; volumes of a family with coefficient of variation `cv`, side ratios spread by `sigma`, density `alpha` = W / (n_r + n_s)."""

    n_r: int
    n_s: int
    d: int
    alpha: float
    family: str = "lognormal"
    cv: float = 1.0
    sigma: float = 0.0
    edge: float = 1e-9
    tolerance: float = 0.05

    def __post_init__(self):
        if self.n_r < 1 or self.n_s < 1 or self.d < 1:
            raise ValueError("sides and dimension must be positive")
        if self.family not in FAMILIES or self.sigma < 0 or not 0 < self.edge < 0.5:
            raise ValueError("unknown family, negative sigma or edge outside (0, 0.5)")
        if (self.family == "exponential" and self.cv != 1) or (self.family == "normal" and not 0 < self.cv < 1) or (self.family == "lognormal" and self.cv <= 0):
            raise ValueError("the family doesn't have this coefficient of variation")
        if not 0 < self.alpha < self.most:
            raise ValueError("the density must lie between 0 and n_r n_s / (n_r + n_s)")

    @property
    def most(self) -> float:
        return self.n_r * self.n_s / (self.n_r + self.n_s)


def tolerance(alpha: float, most: float, relative: float = 0.05, floor: float = 1e-3, cap: float = math.inf, margin: float = 0.5) -> float:
    return max(floor, min(cap, relative * alpha, margin * (most - alpha)))


def _log_volumes(rng: np.random.Generator, n: int, config: BoxConfig) -> np.ndarray:
    """ln Z for volume multipliers Z of mean 1."""
    match config.family:
        case "fixed":
            return np.zeros(n)
        case "exponential":
            return np.log(np.maximum(rng.standard_exponential(n), 5e-324))
        case "lognormal":
            s2 = math.log1p(config.cv**2)
            return rng.standard_normal(n) * math.sqrt(s2) - s2 / 2
    loc, scale = _truncated(config.cv)
    z = np.empty(0)
    while len(z) < n:  # a normal that is cut at zero, by rejection
        x = loc + scale * rng.standard_normal(n)
        z = np.append(z, x[x > 0])
    return np.log(z[:n])


@functools.cache
def _truncated(cv: float) -> tuple[float, float]:
    """Location and scale of a normal that, cut at zero, has mean 1 and this coefficient of variation; found by bisection of location / scale."""
    unit = NormalDist()

    def moments(b: float) -> tuple[float, float]:
        mills = unit.pdf(b) / unit.cdf(b)
        mean = b + mills
        return mean, math.sqrt(max(1 + b * mean - mean * mean, 1e-300)) / mean

    low, high = -8.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if moments(mid)[1] > cv else (low, mid)
    scale = 1 / moments(low)[0]
    return low * scale, scale


def _shapes(rng: np.random.Generator, n: int, config: BoxConfig) -> np.ndarray:
    """Logarithms of side ratios, adding to zero in each row."""
    if config.d == 1 or not config.sigma:
        return np.zeros((n, config.d))
    x = rng.standard_normal((n, config.d)) * config.sigma
    x -= x.mean(axis=1, keepdims=True)
    return x - x.mean(axis=1, keepdims=True)


def _sides(theta: float, volumes: np.ndarray, shapes: np.ndarray, n_side: int, config: BoxConfig) -> np.ndarray:
    return np.exp(np.minimum((theta - math.log(n_side) + volumes[:, None]) / config.d + shapes, math.log1p(-config.edge)))


def overlap_probability(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that intervals of lengths a and b at uniform places in [0, 1) overlap: 1 - (1-a-b)^2 / ((1-a)(1-b)), 1 if a + b >= 1."""
    gap = np.maximum(1 - a - b, 0)
    return 1 - gap * gap / np.maximum((1 - a) * (1 - b), 5e-324)


def log_overlap_probability(log_a: np.ndarray, log_b: np.ndarray) -> np.ndarray:
    """The logarithm of overlap_probability from logarithms of lengths, which may be too short for a double; -inf if either has no length."""
    a, b = np.exp(log_a), np.exp(log_b)
    with np.errstate(divide="ignore", invalid="ignore"):
        miss = 2 * np.log1p(-np.minimum(a + b, 1)) - np.log1p(-a) - np.log1p(-b)
        exact = np.where(a + b >= 1, 0.0, np.log(-np.expm1(miss)))
    short = np.maximum(log_a, log_b) < -40  # there the chance is a + b to the last digit
    return np.where(np.isneginf(log_a) | np.isneginf(log_b), -np.inf, np.where(short, np.logaddexp(log_a, log_b), exact))


class Interval(NamedTuple):
    """Bounds of numbers, element by element: each operation rounds to the nearest double, so one step outward encloses the true value."""

    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def outward(low: np.ndarray, high: np.ndarray) -> Interval:
        return Interval(np.nextafter(low, -np.inf), np.nextafter(high, np.inf))

    def plus(self, x: Interval) -> Interval:
        return Interval.outward(self.low + x.low, self.high + x.high)

    def minus(self, x: Interval) -> Interval:
        return Interval.outward(self.low - x.high, self.high - x.low)

    def times(self, x: Interval) -> Interval:
        """For numbers that aren't negative."""
        return Interval.outward(self.low * x.low, self.high * x.high).within(0, np.inf)

    def over(self, x: Interval) -> Interval:
        """For numbers that aren't negative, divided by positive ones."""
        return Interval.outward(self.low / x.high, self.high / x.low).within(0, np.inf)

    def within(self, low: float, high: float) -> Interval:
        return Interval(np.clip(self.low, low, high), np.clip(self.high, low, high))


def overlap_enclosure(a: np.ndarray, b: np.ndarray) -> Interval:
    """Bounds of the exact overlap probability of doubles a and b in (0, 1): ((1-a-b)(a+b) + ab) / ((1-a)(1-b)), whose terms aren't negative, so short lengths keep their digits."""
    one, x, y = (Interval(v, v) for v in (np.ones_like(a), a, b))
    both = x.plus(y)
    gap = one.minus(both).within(0, 1)
    rest = one.minus(x).times(one.minus(y))
    part = gap.times(both).plus(x.times(y)).over(Interval(np.maximum(rest.low, 5e-324), rest.high)).within(0, 1)
    return Interval(np.where(both.low >= 1, 1.0, part.low), np.where(both.high >= 1, 1.0, part.high))


def stream(seed: int, *domain) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(stable_id("boxloom-stream", seed, *domain, bits=128)))


@dataclass(frozen=True)
class Coverage:
    status: str
    theta: float
    alpha_low: float
    alpha_high: float
    samples: int


def _pairs(config: BoxConfig, seed: int, domain: str, at: int, n: int) -> tuple:
    rng = stream(seed, domain, at)
    return tuple(f(rng, n, config) for _ in "rs" for f in (_log_volumes, _shapes))


def _probabilities(theta: float, drawn: tuple, config: BoxConfig) -> np.ndarray:
    vr, sr, vs, ss = drawn
    return overlap_probability(_sides(theta, vr, sr, config.n_r, config), _sides(theta, vs, ss, config.n_s, config)).prod(axis=1)


class Moments(NamedTuple):
    """Bounds of a sample's sums: at least `low` and at most `high` in all, squares at most `squares`; sums of parts add up outward."""

    n: int
    low: float
    high: float
    squares: float

    @staticmethod
    def of(p: Interval) -> Moments:
        """math.fsum rounds the exact sum once, so one step outward encloses it."""
        up = lambda x: math.nextafter(math.fsum(x), math.inf)
        return Moments(len(p.low), max(0.0, math.nextafter(math.fsum(p.low), -math.inf)), up(p.high), up(np.nextafter(p.high * p.high, np.inf)))

    def plus(self, x: Moments) -> Moments:
        return Moments(self.n + x.n, max(0.0, math.nextafter(self.low + x.low, -math.inf)), math.nextafter(self.high + x.high, math.inf), math.nextafter(self.squares + x.squares, math.inf))

    def bernstein(self, miss: float) -> tuple[float, float]:
        """Bounds of the mean that fail with probability `miss` at most (empirical Bernstein); rational but for a root and a logarithm, which are rounded up."""
        low, high, n = Fraction(self.low) / self.n, Fraction(self.high) / self.n, self.n
        variance = max(Fraction(0), (Fraction(self.squares) - n * low * low) / (n - 1))
        log = Fraction(math.nextafter(math.nextafter(math.log(4 / miss), math.inf), math.inf))
        square = 2 * variance * log / n
        radius = Fraction(math.nextafter(math.sqrt(_up(square)), math.inf)) + 7 * log / (3 * (n - 1))
        return max(0.0, -_up(radius - low)), min(1.0, _up(high + radius))


def _up(x: Fraction) -> float:
    """The least double that isn't below x."""
    y = float(x)
    return y if Fraction(y) >= x else math.nextafter(y, math.inf)


def enclosures(theta: float, drawn: tuple, config: BoxConfig) -> Interval:
    """Bounds of each drawn pair's probability, from its sides as the doubles that they are."""
    vr, sr, vs, ss = drawn
    each = overlap_enclosure(_sides(theta, vr, sr, config.n_r, config), _sides(theta, vs, ss, config.n_s, config))
    return functools.reduce(Interval.times, [Interval(each.low[:, j], each.high[:, j]) for j in range(config.d)]).within(0, 1)


def _looked(batches: Iterator[pa.RecordBatch], config: BoxConfig, theta: float, seed: int, batch: int) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for k in rows.column("id").to_pylist():
            m = Moments.of(enclosures(theta, _pairs(config, seed, "certify", k, batch), config))
            yield pa.RecordBatch.from_pydict({"k": [k]} | {f: [v] for f, v in zip(m._fields, m)})


def moments(config: BoxConfig, theta: float, seed: int, first: int, end: int, batch: int, spark: SparkSession | None = None) -> list[Moments]:
    """The moments of batches first to end - 1 of the certificate's stream, in order; in tasks, if there is a session, and the same in either case."""
    if spark is None:
        return [Moments.of(enclosures(theta, _pairs(config, seed, "certify", k, batch), config)) for k in range(first, end)]
    look = functools.partial(_looked, config=config, theta=theta, seed=seed, batch=batch)
    rows = spark.range(first, end, numPartitions=end - first).mapInArrow(look, "k bigint, n bigint, low double, high double, squares double").collect()  # a row per batch
    return [Moments(*r[1:]) for r in sorted(rows)]


def solve(config: BoxConfig, seed: int = 0, sample: int = 65_536, batch: int = 65_536, batches: int = 64, miss: float = 1e-6, spark: SparkSession | None = None) -> Coverage:
    """Finds theta by bisection on a calibration sample of bounded size, then certifies the density on an independent stream, in tasks if there is a session.

    The certificate is an empirical Bernstein interval over outward bounds of each pair's probability, looked at after 1, 2,
    4, ... batches (the looks share `miss`): CERTIFIED once the interval of the density lies within alpha * (1 +- tolerance),
    DISJOINT if it lies outside, else EXHAUSTED.
    """
    target = config.alpha / config.most
    drawn = _pairs(config, seed, "calibrate", 0, sample)
    mean = lambda theta: math.fsum(_probabilities(theta, drawn, config)) / sample
    low = high = math.log(config.alpha)
    while mean(low) > target:
        low -= math.log(2)
    while mean(high) < target:
        high += math.log(2)
        if high > 1000:
            raise CoverageFailure("no scale reaches the density")
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < target else (low, mid)
    near, far = config.alpha * (1 - config.tolerance), config.alpha * (1 + config.tolerance)
    looks = [min(1 << j, batches) for j in range((batches - 1).bit_length() + 1)]
    found, done = None, 0
    for end in looks:
        found = functools.reduce(Moments.plus, moments(config, high, seed, done, end, batch, spark), *([found] if found else []))
        done = end
        a, b = found.bernstein(miss / len(looks))
        a, b = math.nextafter(a * math.nextafter(config.most, 0), 0), math.nextafter(b * math.nextafter(config.most, math.inf), math.inf)
        if near <= a and b <= far:
            return Coverage("CERTIFIED", high, a, b, found.n)
        if b < near or a > far:
            return Coverage("DISJOINT", high, a, b, found.n)
    return Coverage("EXHAUSTED", high, a, b, found.n)


def _block(batches: Iterator[pa.RecordBatch], config: BoxConfig, theta: float, side: int, seed: int) -> Iterator[pa.RecordBatch]:
    n_side, first = (config.n_r, config.n_s)[side], (0, config.n_r)[side]
    for batch in batches:
        for k in batch.column("id").to_pylist():
            n = min(BLOCK, n_side - k * BLOCK)
            rng = [stream(seed, "boxes", side, what, k) for what in ("volume", "shape", "place")]
            length = _sides(theta, _log_volumes(rng[0], n, config), _shapes(rng[1], n, config), n_side, config)
            low = rng[2].random((n, config.d)) * (1 - length)
            high = low + length
            if not (low < high).all():
                raise FloatingPointError("a side is too short for its place")
            ids = first + k * BLOCK + np.arange(n)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids)} | {f"l{j}": pa.array(low[:, j].copy()) for j in range(config.d)} | {f"u{j}": pa.array(high[:, j].copy()) for j in range(config.d)})


def generate(spark: SparkSession, config: BoxConfig, coverage: Coverage | None = None, seed: int = 0) -> BoxJoin:
    """Both sides, block by block in tasks, each block from streams of its own: the same for any number of partitions. R's ids count from 0, S's from n_r."""
    coverage = coverage or solve(config, seed, spark=spark)
    if coverage.status != "CERTIFIED":
        raise CoverageFailure(f"the density isn't certified: {coverage}")
    schema = ", ".join(["id bigint", *(f"{e}{j} double" for e in "lu" for j in range(config.d))])
    side = lambda s, n: spark.range(-(-n // BLOCK)).mapInArrow(functools.partial(_block, config=config, theta=coverage.theta, side=s, seed=seed), schema)
    return BoxJoin(side(0, config.n_r), side(1, config.n_s))


def description(config: BoxConfig, coverage: Coverage, seed: int) -> dict:
    return {"config": asdict(config), "coverage": asdict(coverage), "seed": seed}


def with_size(config: BoxConfig, n: int, larger_r: bool = True) -> BoxConfig:
    """The configuration for n boxes in all; an odd one goes to R or to S."""
    half = n // 2
    return replace(config, n_r=n - half if larger_r else half, n_s=half if larger_r else n - half)
