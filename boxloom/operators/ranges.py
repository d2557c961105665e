"""Orthogonal range counting and sampling over points, static or changing; many queries at a time."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import decompose
from .boxes import BoxJoin
from .dominance import weighed
from .levels import Levels
from .prefix import counts_at, ranked
from .selection import drawn
from .storage import settled
from .tiles import overlapping


def above(x: Column, bound: Column, strict: Column) -> Column:
    """x > bound, or >= where not strict; a null bound is none."""
    return bound.isNull() | F.when(F.coalesce(strict, F.lit(True)), x > bound).otherwise(x >= bound)


def below(x: Column, bound: Column, strict: Column) -> Column:
    return bound.isNull() | F.when(F.coalesce(strict, F.lit(True)), x < bound).otherwise(x <= bound)


def inside(d: int) -> Column:
    """Whether the point x0.. satisfies the range lo0, hi0, lo0_strict, hi0_strict, .. of its row."""
    sides = [f(F.col(f"x{j}"), F.col(f"{e}{j}"), F.col(f"{e}{j}_strict")) for j in range(d) for e, f in (("lo", above), ("hi", below))]
    return reduce(and_, sides, F.lit(True))


def provably_empty(d: int) -> Column:
    """Inverted bounds, or equal ones of which any is strict."""
    some = [(F.col(f"lo{j}") > F.col(f"hi{j}")) | ((F.col(f"lo{j}") == F.col(f"hi{j}")) & (F.coalesce(f"lo{j}_strict", F.lit(True)) | F.coalesce(f"hi{j}_strict", F.lit(True)))) for j in range(d)]
    return F.coalesce(reduce(or_, some, F.lit(False)), F.lit(False))


def relation(d: int) -> Column:
    """Outside, inside or partial: a block of points with bounds min0, max0, .. against the range of its row."""
    out = [~above(F.col(f"max{j}"), F.col(f"lo{j}"), F.col(f"lo{j}_strict")) | ~below(F.col(f"min{j}"), F.col(f"hi{j}"), F.col(f"hi{j}_strict")) for j in range(d)]
    within = [above(F.col(f"min{j}"), F.col(f"lo{j}"), F.col(f"lo{j}_strict")) & below(F.col(f"max{j}"), F.col(f"hi{j}"), F.col(f"hi{j}_strict")) for j in range(d)]
    return F.when(reduce(or_, out), "outside").when(reduce(and_, within), "inside").otherwise("partial")


def _ends(queries: DataFrame, axis: int, *keys: str) -> DataFrame:
    """(qid, keys, end, x, inclusive): both bounds of an axis as lookups; a missing bound lies before or after all."""
    strict = lambda e: F.coalesce(f"{e}{axis}_strict", F.lit(True))
    low = F.struct(F.lit("lo").alias("end"), F.col(f"lo{axis}").alias("x"), (strict("lo") & F.col(f"lo{axis}").isNotNull()).alias("inclusive"))
    high = F.struct(F.lit("hi").alias("end"), F.col(f"hi{axis}").alias("x"), (~strict("hi") | F.col(f"hi{axis}").isNull()).alias("inclusive"))
    return queries.select("qid", *keys, F.explode(F.array(low, high)).alias("e")).select("qid", *keys, "e.*")


def _interval(points: DataFrame, queries: DataFrame, axis: int, keys: list[str], names: tuple[str, str], n: int | None = None) -> DataFrame:
    """(qid, keys, names): the places of the points in a range's bounds of one axis, in the order of keys and coordinate."""
    found = counts_at(points.select(*keys, F.col(f"x{axis}").alias("x")), _ends(queries, axis, *keys), by=keys, n=n)
    pick = lambda e, name: F.max(F.when(F.col("end") == e, F.col("n_below"))).alias(name)
    return found.groupBy("qid", *keys).agg(pick("lo", names[0]), pick("hi", names[1]))


def _routed(points: DataFrame, queries: DataFrame, d: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points and ranges in the groups of canonical nodes of all axes but the last two: a point in those above its ranks, a range in O(log n) per axis."""
    keys: list[str] = []
    height = max(1, (points.count() - 1).bit_length()) if d > 2 else 1
    p, q = points, queries
    for j in range(d - 2):
        rank = ranked(points.select(f"x{j}", "id"), [f"x{j}", "id"]).select("id", "rank")
        spans = _interval(points, queries, j, [], ("lo", "hi")).where("lo < hi")
        q = q.join(spans, "qid").withColumn(f"k{j}", F.explode(decompose.canonical(0, height))).drop("lo", "hi")
        keys.append(f"k{j}")
        p = p.join(rank, "id").withColumn(f"k{j}", F.explode(decompose.ancestors(0, height=height))).drop("rank").join(q.select(*keys).distinct(), keys, "left_semi")
        p, q = settled(p), settled(q)
    return p, q, keys


class Ranges:
    """Counts and selections in the ranges of `queries` over `points`, for two axes or more: no match is listed.

    The last two axes are the positions and values of a rank/select table, in the order of the canonical nodes of the axes
    before; a range is an interval of each. Its work is log n rows, or log^(d-1) n with further axes, however many points it holds.
    """

    def __init__(self, points: DataFrame, queries: DataFrame, d: int):
        live = queries.where(~provably_empty(d))
        p, q, keys = _routed(points, live, d)
        i, j = d - 2, d - 1
        n, ranges = p.count(), q.count()
        pos = ranked(p.select(*keys, f"x{i}", "id"), [*keys, f"x{i}", "id"], "pos", n=n).select(*keys, "id", "pos")
        val = ranked(p.select(*keys, f"x{j}", "id"), [*keys, f"x{j}", "id"], "val", n=n).select(*keys, "id", "val")
        self.keys, self.points = keys, settled(pos.join(val, [*keys, "id"]))
        self.levels = Levels(self.points)
        spans = _interval(p, q, i, keys, ("a", "b"), n + 2 * ranges).join(_interval(p, q, j, keys, ("c", "d"), n + 2 * ranges), ["qid", *keys])
        self.spans = settled(spans.where("a < b and c < d"))

    def counts(self) -> DataFrame:
        """(qid, keys, a, b, under, n): the points of each part of a range, and how many of its positions a .. b are under its values."""
        ask = F.explode(F.array(*[F.struct(F.col(p).alias("first"), F.col(v).alias("value"), F.lit(v).alias("end"), F.lit(sign).alias("sign")) for p, sign in (("a", -1), ("b", 1)) for v in "cd"]))
        asked = self.spans.select("qid", *self.keys, "a", "b", ask.alias("e")).select("qid", *self.keys, "a", "b", "e.*")
        found = self.levels.below(asked).groupBy("qid", *self.keys, "a", "b")
        of = lambda v: F.sum(F.when(F.col("end") == v, F.col("sign") * F.col("n")))
        return found.agg(of("c").alias("under"), (of("d") - of("c")).alias("n")).where("n > 0")


def _places(points: DataFrame, queries: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """points(id, r0, ..) by their ranks on each axis, and queries(qid, l0, u0, ..) as intervals of these, without those that are empty on an axis."""
    n, ranges = points.count(), queries.count()
    p, q = points.select("id", *[f"x{j}" for j in range(d)]), queries.select("qid")
    for j in range(d):
        q = q.join(_interval(points, queries, j, [], (f"l{j}", f"u{j}"), n + 2 * ranges).where(f"l{j} < u{j}"), "qid")
        p = ranked(p, [f"x{j}", "id"], f"r{j}", n=n).drop(f"x{j}")
    return p, q


def _counted(points: DataFrame, queries: DataFrame, d: int) -> DataFrame:
    """(qid, n) of ranges that aren't empty, on three axes or more: every axis becomes ranks, of which a range has an interval, and chunks of points meet chunks of ranges."""
    p, q = _places(points, queries, d)
    axes = [[(f"r{j}", f"u{j}", False, 1), (f"r{j}", f"l{j}", False, -1)] for j in range(d)]
    return weighed(p, q.withColumnRenamed("qid", "id"), axes).select(F.col("id").alias("qid"), F.col("weight").alias("n"))


def range_count(points: DataFrame, queries: DataFrame, d: int, width: float | None = None) -> DataFrame:
    """(qid, n) for every query, zero included; ids of points are unique. `width`, which callers may give, has no effect: there are no cells."""
    if d == 1:
        spans = _interval(points, queries.where(~provably_empty(1)), 0, [], ("a", "b")).where("a < b")
        n = spans.select("qid", (F.col("b") - F.col("a")).alias("n"))
    elif d > 2:
        n = _counted(points, queries.where(~provably_empty(d)), d)
    else:
        n = Ranges(points, queries, d).counts().groupBy("qid").agg(F.sum("n").alias("n"))
    return queries.select("qid").join(n, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def range_draws(points: DataFrame, queries: DataFrame, d: int, t: int, seed: str) -> DataFrame:
    """(qid, pos, id): t independent uniform points with replacement of each range that isn't empty.

    A range's points are numbered by the last axis, then id, and no match is listed.
    """
    p, q = _places(points, queries.where(~provably_empty(d)), d)
    return drawn(p.withColumn("at", F.col(f"r{d - 1}")), q, d, t, seed, axis=d - 1)


def range_sample(points: DataFrame, queries: DataFrame, d: int, t: int, seed: str, width: float | None = None) -> DataFrame:
    """range_draws() with a range's points numbered by id. `width`, which callers may give, has no effect: there are no cells."""
    p, q = _places(points, queries.where(~provably_empty(d)), d)
    return drawn(ranked(p, ["id"], "at", n=points.count()), q, d, t, seed)


def activity_errors(log: DataFrame) -> DataFrame:
    """Entries of log(seq, id, delta) that insert what is active (+1) or delete what isn't (-1)."""
    before = F.lag("delta", 1, -1).over(Window.partitionBy("id").orderBy("seq"))
    return log.withColumn("before", before).where("before = delta").drop("before")


def _spans(log: DataFrame) -> DataFrame:
    """(id, since, until): an insertion lasts until the point's next entry, null if there is none, so activity is an interval of seq and no state is replayed."""
    until = F.lead("seq").over(Window.partitionBy("id").orderBy("seq"))
    spans = log.withColumn("until", until.cast("bigint")).where("delta = 1")
    return spans.select("id", F.col("seq").cast("bigint").alias("since"), "until")


def active_at(log: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id) of the points that are active at each query's seq: the last entry up to it is an insertion. Intervals and moments meet in tiles, no pair is shuffled."""
    last = max([x for df in (log, queries) if (x := df.agg(F.max("seq").cast("bigint")).first()[0]) is not None], default=0)
    spans = _spans(log).select("id", F.col("since").alias("l0"), F.coalesce("until", F.lit(last + 1)).alias("u0"))
    at = F.col("seq").cast("bigint")
    moments = queries.select(F.col("qid").alias("id"), at.alias("l0"), (at + F.lit(1).cast("bigint")).alias("u0"))
    return overlapping(BoxJoin(spans, moments)).select(F.col("s_id").alias("qid"), F.col("r_id").alias("id"))


def active_range_count(points: DataFrame, log: DataFrame, queries: DataFrame, d: int) -> DataFrame:
    """Range counts over the points that are active at each query's seq: those begun up to it less those ended up to it.

    Both are counts of ranges with one more axis, the time, which is bounded above; seq is unique and numbers the intervals.
    """
    spans = settled(_spans(log).join(points, "id"))
    old = [c for j in range(d) for c in (f"lo{j}", f"hi{j}", f"lo{j}_strict", f"hi{j}_strict")]
    axes = [F.col(c).alias(re.sub(r"\d+", lambda m: str(int(m[0]) + 1), c)) for c in old]
    timed = queries.select("qid", F.lit(None).cast("bigint").alias("lo0"), F.col("seq").cast("bigint").alias("hi0"), F.lit(False).alias("lo0_strict"), F.lit(False).alias("hi0_strict"), *axes)
    parts = []
    for end, sign in (("since", 1), ("until", -1)):
        at = spans.where(F.col(end).isNotNull()).select(F.col(end).alias("id"), F.col(end).alias("x0"), *[F.col(f"x{j}").alias(f"x{j + 1}") for j in range(d)])
        parts.append(range_count(at, timed, d + 1).select("qid", (F.lit(sign) * F.col("n")).alias("n")))
    return parts[0].unionAll(parts[1]).groupBy("qid").agg(F.sum("n").cast("bigint").alias("n"))
