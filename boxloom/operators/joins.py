"""Overlap joins: the theta join, a grid join by levels of size, and counts that never list pairs."""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dominance
from .boxes import BoxJoin, closed_overlaps, overlaps, ownership, side


def theta_pairs(join: BoxJoin) -> DataFrame:
    """All columns of both sides for each overlapping pair, by the plain predicate; Spark compares all with all. For small inputs and as a check."""
    j = join.clean()
    return side(j.r, "r_").join(side(j.s, "s_"), overlaps(j.d))


def theta_total(join: BoxJoin, chunk: int | None = None) -> DataFrame:
    """count() of theta_pairs() with no pair formed: the plain predicate over tiles of both sides, by bounds where these tell, else row by row."""
    j = join.clean()
    return dominance.met_total(j.s, j.r, [dominance.overlap(k) for k in range(j.d)], chunk).select(F.col("n").alias("w"))


def cell(x: Column, size: Column, whole: bool) -> Column:
    """floor(x / size), exact for integers."""
    if whole:
        return F.call_function("div", x - F.pmod(x, size), size)
    return F.floor(x / size).cast("bigint")


def widths(join: BoxJoin, axes: int) -> list[float]:
    """Cell widths of the finest level: the mean extent of both sides' boxes on each axis."""
    j = join.clean()
    ends = [f"{e}{k}" for k in range(axes) for e in "lu"]
    both = j.r.select(ends).unionAll(j.s.select(ends))
    row = both.agg(*[F.avg(F.col(f"u{k}").cast("double") - F.col(f"l{k}").cast("double")).alias(f"w{k}") for k in range(axes)]).first()
    whole = dict(j.r.dtypes)["l0"] == "bigint"
    return [max(1, round(row[k] or 1)) if whole else (row[k] or 1.0) for k in range(axes)]


def grid_pairs(join: BoxJoin, axes: int | None = None, width: list[float] | None = None, levels: int = 40) -> DataFrame:
    """All columns of both sides for each overlapping pair, each pair once, by equi-joins on grid cells.

    A box lies at the level whose cells (doubling in width from level to level) are at least as large as it is, so it
    covers at most two cells per axis there and on coarser levels. A pair meets at the coarser of its two levels, in the
    cell of the greater lower endpoint on each axis, which makes duplicates impossible. A box is listed at a coarser level
    only if the other side has boxes of that level, so large boxes don't multiply small ones.
    """
    j = join.clean()
    axes = min(j.d, 2) if axes is None else axes
    width = width or widths(j, axes)
    whole = dict(j.r.dtypes)["l0"] == "bigint"
    kind = "bigint" if whole else "double"

    def leveled(df: DataFrame, prefix: str) -> DataFrame:
        over = F.greatest(F.lit(1.0), *[(F.col(f"u{k}").cast("double") - F.col(f"l{k}").cast("double")) / F.lit(float(width[k])) for k in range(axes)])
        return side(df.withColumn("level", F.least(F.lit(levels), F.ceil(F.log2(over)).cast("int"))), prefix)

    def present(df: DataFrame, prefix: str) -> list[int]:
        return sorted(x[0] for x in df.select(f"{prefix}level").distinct().collect())

    def listed(df: DataFrame, prefix: str, at: Column) -> DataFrame:
        """A row for each cell that the box covers at each level of the array `at`."""
        out = df.withColumn("level", F.explode(at))
        for k in range(axes):
            size = F.lit(width[k]).cast(kind) * F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level")).cast(kind)
            last = cell(F.col(f"{prefix}u{k}") - F.lit(1).cast("bigint"), size, whole) if whole else F.floor(F.col(f"{prefix}u{k}") / size).cast("bigint")
            out = out.withColumn(f"c{k}", F.explode(F.sequence(cell(F.col(f"{prefix}l{k}"), size, whole), last)))
        return out

    r, s = leveled(j.r, "r_"), leveled(j.s, "s_")
    r_levels, s_levels = present(r, "r_"), present(s, "s_")
    above = lambda prefix, found: F.filter(F.array(*[F.lit(x) for x in found]).cast("array<int>"), lambda x: x > F.col(f"{prefix}level"))
    at_home = lambda prefix: F.array(F.col(f"{prefix}level"))
    keys = ["level", *[f"c{k}" for k in range(axes)]]

    def owner() -> Column:
        same = []
        for k in range(axes):
            size = F.lit(width[k]).cast(kind) * F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level")).cast(kind)
            same.append(F.col(f"c{k}") == cell(F.greatest(f"r_l{k}", f"s_l{k}"), size, whole))
        return reduce(lambda a, b: a & b, same)

    met = []
    for r_at, s_at in ((at_home("r_"), at_home("s_")), (at_home("r_"), above("s_", r_levels)), (above("r_", s_levels), at_home("s_"))):
        met.append(listed(r, "r_", r_at).join(listed(s, "s_", s_at), keys).where(owner() & overlaps(j.d)).drop(*keys))
    return met[0].unionByName(met[1]).unionByName(met[2]).drop("r_level", "s_level")


def pairs(joined: DataFrame) -> DataFrame:
    return joined.select("r_id", "s_id")


def count(joined: DataFrame) -> DataFrame:
    """W, the number of overlapping pairs."""
    return joined.agg(F.count("*").cast("bigint").alias("w"))


def degrees(joined: DataFrame) -> DataFrame:
    """Partners of each R box that has one."""
    return joined.groupBy("r_id").agg(F.count("*").cast("bigint").alias("degree"))


def degrees_counted(join: BoxJoin) -> DataFrame:
    """degrees() without forming a pair on one axis or two: S boxes that begin before R's ends, less those that have ended."""
    j = join.clean()
    if j.d > 2:
        return degrees(grid_pairs(j))
    return dominance.weighed(j.s, j.r, [dominance.overlap(k) for k in range(j.d)]).select(F.col("id").alias("r_id"), F.col("weight").alias("degree"))


def total_counted(join: BoxJoin) -> DataFrame:
    """count() without forming a pair on one axis or two."""
    if join.d > 2:
        return count(grid_pairs(join))
    return degrees_counted(join).agg(F.coalesce(F.sum("degree"), F.lit(0)).cast("bigint").alias("w"))


def ownership_counted(join: BoxJoin) -> DataFrame:
    """ownership_counts() without forming a pair on one axis or two: R owns what begins within it, S what it begins within."""
    j = join.clean()
    if j.d > 2:
        return ownership_counts(grid_pairs(j), j.d)
    halves = [{1: dominance.begun_in(k, True), 0: dominance.open_at(k, False)} for k in range(j.d)]
    terms = list(product(*[sorted({h[:3] for x in of.values() for h in x}) for of in halves]))
    counted = dominance.term_counts(j.s, j.r, [[(*h, 1) for h in t] for t in terms]).groupBy("term").agg(F.sum("n").alias("n"))
    signs = []  # of each term in each class
    for t in terms:
        sign = lambda own, t=t: prod(sum(g for *h, g in halves[k][own >> k & 1] if tuple(h) == t[k]) for k in range(j.d))
        signs.append(F.array(*[F.lit(sign(own)).cast("bigint") for own in range(1 << j.d)]))
    each = counted.select("n", F.posexplode(F.get(F.array(*signs), F.col("term"))).alias("own", "sign"))  # a row per term and class
    return each.groupBy(F.col("own").cast("bigint").alias("own")).agg(F.sum(F.col("sign") * F.col("n")).cast("bigint").alias("pairs")).where("pairs > 0")


def ownership_counts(joined: DataFrame, d: int) -> DataFrame:
    """Pairs of each of the 2^d orientation classes; they add up to W."""
    return joined.groupBy(ownership(d).alias("own")).agg(F.count("*").cast("bigint").alias("pairs"))


def touching_pairs(join: BoxJoin, cells: int = 1024) -> DataFrame:
    """Pairs that meet only under closed comparison, by equi-joins on the touching endpoint of each axis; ids are unique.

    A pair is given by the first endpoint at which it touches, so pairs aren't compared with each other. With a second axis,
    boxes are also listed in its cells, at most about `cells` of them, and a pair meets in that of its greater lower endpoint.
    """
    j = join.clean()
    r, s = side(j.r, "r_"), side(j.s, "s_")
    whole = dict(j.r.dtypes)["l0"] == "bigint"
    size = []
    if j.d > 1:
        both = j.r.select(*[f"{e}{k}" for k in range(j.d) for e in "lu"]).unionAll(j.s.select(*[f"{e}{k}" for k in range(j.d) for e in "lu"]))
        span = both.agg(*[f(f"{e}{k}").cast("double").alias(f"{e}{k}") for k in range(j.d) for e, f in (("l", F.min), ("u", F.max))]).first()
        least = [((span[f"u{k}"] or 0.0) - (span[f"l{k}"] or 0.0)) / cells for k in range(j.d)]
        size = [F.lit(max(1, round(max(w, x))) if whole else max(w, x)).cast("bigint" if whole else "double") for w, x in zip(widths(j, j.d), least)]

    def listed(df: DataFrame, prefix: str, k: int) -> DataFrame:
        return df.withColumn("cell", F.explode(F.sequence(cell(F.col(f"{prefix}l{k}"), size[k], whole), cell(F.col(f"{prefix}u{k}"), size[k], whole))))

    found, earlier = [], F.lit(False)
    for k in range(j.d):
        o = (k + 1) % j.d
        for a, b in ((f"r_u{k}", f"s_l{k}"), (f"r_l{k}", f"s_u{k}")):
            if j.d > 1:
                met = listed(r, "r_", o).join(listed(s, "s_", o).withColumnRenamed("cell", "s_cell"), (F.col(a) == F.col(b)) & (F.col("cell") == F.col("s_cell")))
                met = met.where(F.col("cell") == cell(F.greatest(f"r_l{o}", f"s_l{o}"), size[o], whole))
            else:
                met = r.join(s, F.col(a) == F.col(b))
            found.append(met.where(closed_overlaps(j.d) & ~earlier).select("r_id", "s_id"))
            earlier = earlier | (F.col(a) == F.col(b))
    return reduce(DataFrame.unionAll, found)


def contact_counts(join: BoxJoin) -> DataFrame:
    """For d = 2: pairs in contact by axis and orientation, corner contacts, and all contacts, without listing pairs.

    Along an axis, boxes meet on an endpoint value; the closed overlaps on the other axis of one such group are its pairs
    less those wholly before and wholly after. Equal corners count on both axes and are taken off once.
    """
    j = join.clean()

    def closed(r_touch: str, s_touch: str, o: int) -> DataFrame:
        ev = lambda df, touch, c, side_, kind: df.select(F.col(touch).alias("v"), F.col(c).alias("x"), F.lit(side_).alias("side"), F.lit(kind).alias("kind"))
        # kinds order equal coordinates: R's lower before S's endpoints before R's upper
        s_upper = ev(j.s, s_touch, f"u{o}", 1, 2).withColumn("up", F.lit(1)).withColumn("low", F.lit(0))
        s_lower = ev(j.s, s_touch, f"l{o}", 1, 2).withColumn("up", F.lit(0)).withColumn("low", F.lit(1))
        r_lower = ev(j.r, r_touch, f"l{o}", 0, 1).withColumn("up", F.lit(0)).withColumn("low", F.lit(0))
        r_upper = ev(j.r, r_touch, f"u{o}", 0, 3).withColumn("up", F.lit(0)).withColumn("low", F.lit(0))
        w = Window.partitionBy("v").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, -1)
        run = s_upper.unionAll(s_lower).unionAll(r_lower).unionAll(r_upper).withColumn("ended", F.coalesce(F.sum("up").over(w), F.lit(0))).withColumn("begun", F.coalesce(F.sum("low").over(w), F.lit(0)))
        # pairs = S begun by R's upper end - S ended before R's lower end
        return run.where("side = 0").agg(F.coalesce(F.sum(F.when(F.col("kind") == 3, F.col("begun")).otherwise(-F.col("ended"))), F.lit(0)).cast("bigint").alias("n"))

    def corner(rx: str, ry: str, sx: str, sy: str) -> DataFrame:
        a = j.r.groupBy(F.col(rx).alias("x"), F.col(ry).alias("y")).agg(F.count("*").alias("a"))
        b = j.s.groupBy(F.col(sx).alias("x"), F.col(sy).alias("y")).agg(F.count("*").alias("b"))
        return a.join(b, ["x", "y"]).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).cast("bigint").alias("n"))

    parts = [
        closed("u0", "l0", 1).select(F.lit("x_upper_lower").alias("contact"), "n"), closed("l0", "u0", 1).select(F.lit("x_lower_upper"), "n"),
        closed("u1", "l1", 0).select(F.lit("y_upper_lower"), "n"), closed("l1", "u1", 0).select(F.lit("y_lower_upper"), "n"),
    ]
    corners = reduce(DataFrame.unionAll, [corner(rx, ry, sx, sy) for rx, sx in (("u0", "l0"), ("l0", "u0")) for ry, sy in (("u1", "l1"), ("l1", "u1"))])
    corners = corners.agg(F.sum("n").cast("bigint").alias("n")).select(F.lit("corner"), "n")
    listed = reduce(DataFrame.unionAll, [*parts, corners])
    total = listed.agg(F.sum(F.when(F.col("contact") == "corner", -F.col("n")).otherwise(F.col("n"))).cast("bigint")).select(F.lit("all"), "*")
    return listed.unionAll(total)


def stab(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """The one interval [start, end) of each point z; a point in none or several is an error. Each distinct z is looked up once, by cells."""
    one = F.lit(1).cast("bigint")
    at = points.select("z").where("z is not null").distinct().select(F.col("z").alias("id"), F.col("z").cast("bigint").alias("l0"), (F.col("z").cast("bigint") + one).alias("u0"))
    spans = intervals.select(F.col("start").alias("id"), F.col("start").cast("bigint").alias("l0"), F.col("end").cast("bigint").alias("u0"), F.struct("*").alias("interval"))
    found = grid_pairs(BoxJoin(at, spans)).groupBy(F.col("r_id").alias("z")).agg(F.count("*").alias("n"), F.any_value("s_interval").alias("interval"))
    met = points.join(found, "z", "left")
    wrong = F.raise_error(F.lit("a point needs exactly one interval")).cast("bigint")
    return met.withColumn("z", F.when(F.col("n") == 1, F.col("z")).otherwise(wrong)).select(*points.columns, "interval.*")


def invalid_pairs(join: BoxJoin, sample: DataFrame) -> DataFrame:
    """Rows of sample(r_id, s_id, ..) that aren't pairs of the join: an unknown id, or boxes that don't overlap strictly."""
    j = join.clean()
    met = sample.join(side(j.r, "r_"), "r_id", "left").join(side(j.s, "s_"), "s_id", "left")
    return met.where(~F.coalesce(overlaps(j.d), F.lit(False))).select(*sample.columns)
