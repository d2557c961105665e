"""Ranks and running sums without a single-task window: ranges of the whole order, then offsets per range; over a relation, or in groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settled

#: Rows that one range, or one window, may hold before more ranges are used.
ROWS = 1 << 20


def in_ranges(df: DataFrame, order: Sequence[str | Column], ranges: int) -> DataFrame:
    """df with `range_no`, dealt by ranges of the whole order, then of a hash of the row, so that rows of one first key are split too.

    Written once: what is summed by range and what is numbered in it are the same rows. Ranges are as many as asked for, so
    they keep their size at every size of df.
    """
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return settled(df.withColumn("_tie", tie).repartitionByRange(ranges, *order, "_tie").withColumn("range_no", F.spark_partition_id()))


def running(df: DataFrame, order: Sequence[str | Column], sums: dict[str, Column], rows: int = ROWS, before: bool = True, n: int | None = None) -> DataFrame:
    """Adds each of `sums` as a running total in `order` over all rows, up to the row before (`before`) or to the row itself.

    Beyond `rows` rows, ranges of about as many are summed apart and the totals of earlier ranges (one row per range, which
    is what is broadcast) are added. `n` is the number of rows, where it is known.
    """
    own = lambda *by: Window.partitionBy(*by).orderBy(*order, *(["_tie"] if by else [])).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = lambda d, w: d.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(name) for name, c in sums.items()])
    ranges = -(-(df.count() if n is None else n) // rows)
    if ranges <= 1:
        return local(df, own())
    dealt = in_ranges(df, order, ranges)
    totals = dealt.groupBy("range_no").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("range_no").alias("_range"), *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums])
    joined = local(dealt, own("range_no")).join(F.broadcast(offsets), F.col("range_no") == F.col("_range"))
    return joined.select(*df.columns, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums])


def hot_groups(df: DataFrame, keys: Sequence[str], rows: int = ROWS) -> DataFrame | None:
    """The keys of groups with more than `rows` rows, of which there are few: at most one for `rows` rows of df. None if there is none."""
    hot = settled(df.groupBy(*keys).count().where(F.col("count") > rows).select(*keys))
    return None if hot.isEmpty() else hot


def segmented(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column], hot: DataFrame | None, rows: int = ROWS, before: bool = True) -> DataFrame:
    """running() within each group of `keys`. Groups of usual size are a window each; those in `hot` are cut into ranges like a whole relation.

    A hot group's sums are those over all hot groups in the order of their keys, less the totals of the groups before it.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    usual = df if hot is None else df.join(F.broadcast(hot), list(keys), "left_anti")
    out = usual.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(name) for name, c in sums.items()])
    if hot is None:
        return out
    large = df.join(F.broadcast(hot), list(keys), "left_semi")
    totals = large.groupBy(*keys).agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    earlier = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums])
    summed = running(large, [*keys, *order], sums, rows, before).join(F.broadcast(offsets), list(keys))
    return out.unionByName(summed.select(*df.columns, *[(F.col(name) - F.col(f"_{name}")).alias(name) for name in sums]))


def ranked(df: DataFrame, order: Sequence[str], name: str = "rank", rows: int = ROWS, n: int | None = None) -> DataFrame:
    """Adds the 0-based rank of each row in `order`."""
    return running(df, order, {name: F.lit(1).cast("bigint")}, rows, n=n)


def counts_at(points: DataFrame, at: DataFrame, coord: str = "x", name: str = "n_below", rows: int = ROWS, by: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """For each row of at(coord, inclusive, ...): the number of points below its coordinate, or at it too where `inclusive`.

    With `by`, points and rows are first in the order of those columns: a row counts all points of earlier groups too. A null
    coordinate of a row is below its group's points, or after them where `inclusive`. One union in order of coordinate, so a
    lookup costs a sort, not a search: queries stand before equal points, or after them where they include them. Equal points
    are one row, so a coordinate that very many have is no hot one. `n` bounds the rows of both, where that is known.
    """
    keys = [F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]
    order = [*[f"_b{i}" for i in range(len(by))], "_end", "_x", "_tie_"]
    p = points.groupBy(*keys, F.col(coord).alias("_x")).agg(F.count("*").alias("_one"))
    p = p.select(*order[:-3], F.lit(0).alias("_end"), "_x", F.lit(1).alias("_tie_"), "_one", F.lit(None).cast(_struct(at)).alias("_row"))
    end = F.when(F.col(coord).isNotNull(), 0).when(F.col("inclusive"), 1).otherwise(-1)
    q = at.select(*keys, end.alias("_end"), F.col(coord).alias("_x"), F.when(F.col("inclusive"), 2).otherwise(0).alias("_tie_"), F.lit(0).cast("bigint").alias("_one"), F.struct(*at.columns).alias("_row"))
    summed = running(p.unionAll(q), order, {name: F.col("_one")}, rows, n=n)
    return summed.where("_row is not null").select("_row.*", name)


def _struct(df: DataFrame) -> str:
    return df.schema.simpleString()
