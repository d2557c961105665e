"""Deterministic stratified selection: ranks as ids, half splits, largest-remainder quotas, lowest priorities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import canonical_integers, stable_hex
from .prefix import ranked, running

#: Tags of the hashed orders (fixed values).
STRATUM_TAG, OBJECT_TAG, USER_TAG, IMAGE_TAG, PROPOSAL_TAG, QUOTA_TAG = (
    "cmab-hf-stratum-v1", "cmab-hf-building-split-v1", "geolife-hf-user-split-v1", "coco-image-subset", "coco-hf-proposal-split-v1", "geolife-hf-stratum-quota-v1",
)


def rank_ids(df: DataFrame, order: Sequence[str], name: str = "object_id") -> DataFrame:
    """Dense ids from 0 in the order of the source key; a repeated key is an error."""
    again = F.count("*").over(Window.partitionBy(*order))
    checked = df.withColumn("_n", again).withColumn(order[0], F.when(F.col("_n") == 1, F.col(order[0])).otherwise(F.raise_error(F.lit("the source key isn't unique")).cast(dict(df.dtypes)[order[0]]))).drop("_n")
    return ranked(checked, order, name)


def shared_ids(df: DataFrame, side: str, key: str, name: str = "object_id") -> DataFrame:
    """Adds dense ids from 0 in the order of the key that hold over both sides: a key that both have is one object."""
    ids = ranked(df.select(key).distinct(), [key], name)
    return df.join(ids, key).select(side, key, name)


def repeats(df: DataFrame, key: str) -> DataFrame:
    """Distinct values of a published key, values that occur more than once, rows beyond the first, the most rows of one value."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    out = n.agg(F.count("*").alias("distinct_keys"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("repeated_keys"), F.sum(F.col("n") - 1).alias("excess_rows"), F.max("n").alias("most"))
    return out.select(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in out.columns])


def tile(x: Column, size: int) -> Column:
    """floor(x / size), for negative numbers too; exact for integers."""
    return F.floor(x / F.lit(float(size))).cast("bigint")


def half_split(df: DataFrame, strata: Sequence[str], id: str, target: int, stratum_tag: str = STRATUM_TAG, object_tag: str = OBJECT_TAG) -> DataFrame:
    """Adds `side`: half of each stratum to R, the odd ones out of strata in hashed order until R has `target` rows; rest to S.

    Within a stratum rows go in the order of their hashed id. A target that halves can't meet is an error.
    """
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_size"))
    halves = sizes.withColumn("_key", stable_hex(stratum_tag, canonical_integers(*[F.col(c) for c in strata]))).withColumn("_first", F.conv(F.substring("_key", 1, 15), 16, 10).cast("bigint"))
    placed = running(halves, ["_first", "_key", *strata], {"_odds": F.col("_size") % 2}, before=False)  # _first is in the order of _key
    totals = sizes.agg((F.lit(target) - F.sum(F.call_function("div", F.col("_size"), F.lit(2).cast("bigint")))).alias("_missing"), F.sum(F.col("_size") % 2).alias("_odd"))
    odd = placed.crossJoin(F.broadcast(totals))
    fits = (F.col("_missing") >= 0) & (F.col("_missing") <= F.col("_odd"))
    extra = ((F.col("_size") % 2 == 1) & (F.col("_odds") <= F.col("_missing"))).cast("bigint")
    quota = F.when(fits, F.call_function("div", F.col("_size"), F.lit(2).cast("bigint")) + extra).otherwise(F.raise_error(F.lit("the target doesn't fit halves of the strata")).cast("bigint"))
    quotas = odd.select(*strata, quota.alias("_quota"))
    within = Window.partitionBy(*strata).orderBy(stable_hex(object_tag, F.col(id).cast("string")), id)
    ranked_ = df.withColumn("_place", F.row_number().over(within))
    return ranked_.join(quotas, list(strata)).withColumn("side", F.when(F.col("_place") <= F.col("_quota"), "R").otherwise("S")).drop("_place", "_quota")


def alternate_users(df: DataFrame, user: str, tag: str = USER_TAG) -> DataFrame:
    """(user, side): distinct users in hashed order, even places to R, odd ones to S."""
    users = df.select(user).distinct().withColumn("_h", stable_hex(tag, F.col(user).cast("string")))
    return ranked(users, ["_h", user], "_rank").select(user, F.when(F.col("_rank") % 2 == 0, "R").otherwise("S").alias("side"))


def largest_remainder(sizes: DataFrame, size: str, total: int | Column, tie: Sequence[Column | str], by: Sequence[str] = ()) -> DataFrame:
    """Adds `quota`: total shared in proportion to `size`, floors first, then one each by greatest remainder, ties in order of `tie`.

    Exact integer arithmetic within each group of `by`; asking for more than there is is an error.
    """
    total = F.lit(total) if isinstance(total, int) else total
    whole = Window.partitionBy(*by)
    wide = lambda c: c.cast("decimal(38,0)")
    base = sizes.withColumn("_sum", F.sum(size).over(whole)).withColumn("_prod", wide(total) * wide(F.col(size)))
    share = F.when(F.col("_sum") >= total, F.floor(F.call_function("div", F.col("_prod"), wide(F.col("_sum"))))).otherwise(F.raise_error(F.lit("more is asked for than there is")).cast("bigint"))
    base = base.withColumn("_floor", F.when(F.col("_sum") > 0, share.cast("bigint")).otherwise(F.lit(0).cast("bigint"))).withColumn("_rest", F.when(F.col("_sum") > 0, F.col("_prod") % wide(F.col("_sum"))).otherwise(0))
    base = base.withColumn("_missing", total - F.sum("_floor").over(whole))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_rest").desc(), *tie))
    return base.withColumn("quota", F.col("_floor") + F.when(place <= F.col("_missing"), 1).otherwise(0)).drop("_sum", "_prod", "_floor", "_rest", "_missing")


def stratified_select(df: DataFrame, side: str, strata: Sequence[str], priority: Sequence[str], target: int, tag: str = QUOTA_TAG) -> DataFrame:
    """The `target` rows of each side: quotas of its strata by largest remainder, then the lowest priorities of each stratum."""
    sizes = df.groupBy(side, *strata).agg(F.count("*").alias("_size"))
    tie = [stable_hex(tag, F.concat(F.lit('"'), F.col(side), F.lit('"')), canonical_integers(*[F.col(c) for c in strata])), *strata]
    quotas = largest_remainder(sizes, "_size", target, tie, [side]).drop("_size")
    within = Window.partitionBy(side, *strata).orderBy(*priority)
    return df.withColumn("_place", F.row_number().over(within)).join(quotas, [side, *strata]).where("_place <= quota").drop("_place", "quota")


def lowest_hashes(df: DataFrame, key: Sequence[Column], n: int, tag: str, ties: Sequence[str]) -> DataFrame:
    """The n rows of least hashed key: a top-n that is merged from the tasks' own."""
    return df.withColumn("_h", stable_hex(tag, *key)).orderBy("_h", *ties).limit(n).drop("_h")


def halves_within(df: DataFrame, group: Sequence[str], key: Sequence[Column], n: int, tag: str, ties: Sequence[str]) -> DataFrame:
    """Adds `side`: within each group the n rows of least hashed key are R, the others S."""
    order = Window.partitionBy(*group).orderBy(stable_hex(tag, *key), *ties)
    return df.withColumn("side", F.when(F.row_number().over(order) <= n, "R").otherwise("S"))


def quantiles(df: DataFrame, group: Sequence[str], column: str, at: Sequence[float] = (0.0, 0.5, 0.9, 1.0)) -> DataFrame:
    """Exact interpolated quantiles of a column by group."""
    q = df.groupBy(*group).agg(F.expr(f"percentile(`{column}`, array({', '.join(map(str, at))}))").alias("_q"))
    return q.select(*group, *[F.col("_q")[i].alias(f"q{round(100 * a)}") for i, a in enumerate(at)])


def selection_summary(candidates: DataFrame, selected: DataFrame, user: str, stratum: Sequence[str]) -> DataFrame:
    """(part, rows, users, strata) of the candidates and of what was selected from them; a null user or stratum counts as one."""
    told = lambda df, part: df.agg(F.count("*").alias("rows"), F.countDistinct(F.struct(user)).alias("users"), F.countDistinct(F.struct(*stratum)).alias("strata")).select(F.lit(part).alias("part"), "rows", "users", "strata")
    return told(candidates, "candidates").unionAll(told(selected, "selected"))
