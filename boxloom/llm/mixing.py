"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks to sources, then to shards."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, table, unpacked

#: Weights of the sources in order of code point, repeating; a source is used at most so many times.
WEIGHTS, MOST = (5, 2, 1), 3
#: Words of a block; a source of n words has the square root of n / SHARD shards, so that both their number and their
#: size grow slower than the source; the seed of the selection.
BLOCK, SHARD, SEED = 16, 256, "mix-1"


def size_of(text: Column) -> Column:
    """Number of words: runs of other characters than white space (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, rank) -> with target: shares of the total by weight, capped at `most` times the source.

    A source is capped when `most * size / weight` lies below the level that the rest would share; sources in order of
    that ratio are capped one after another, so the level follows from prefix sums. One row per source is all that is
    in one task here.
    """
    order = Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.sum("weight").over(rest).cast("double"))
        .withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce("final", F.lit(0.0)) * F.col("weight")))
        .select("source", "rank", "source_size", "total", "target")
    )


def apportioned(df: DataFrame, group: list[str], item: list[str], votes: Column, seats: Column) -> DataFrame:
    """Adds `quota`: the seats of each item of a group by Sainte-Lague (highest quotients votes / (2k+1), ties by item).

    Only the seats near the last quotient are ranked: a divisor that gives too few seats fixes most of them at once, one
    that gives enough bounds the rest to about twice the number of items.
    """
    whole, by = Window.partitionBy(*group), Window.partitionBy(*group)
    base = (
        df.withColumn("_v", votes.cast("double"))
        .withColumn("_n", seats.cast("double"))
        .withColumn("_sum", F.sum("_v").over(whole))
        .withColumn("_half", F.count("*").over(whole) / F.lit(2.0) + 1)
    )
    seat = lambda n: F.when((n > 0) & (F.col("_sum") > 0), F.floor(F.col("_v") * n / F.col("_sum") + 0.5)).otherwise(F.lit(0)).cast("long")
    base = base.withColumn("_few", seat(F.col("_n") - F.col("_half"))).withColumn("_many", seat(F.col("_n") + F.col("_half")))
    base = base.withColumn("_free", F.col("_n").cast("long") - F.sum("_few").over(by))
    more = (
        base.where("_many > _few")
        .withColumn("_k", F.explode(F.sequence(F.col("_few"), F.col("_many") - 1)))
        .withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy((F.col("_v") / (2 * F.col("_k") + 1)).desc(), *item, "_k")))
        .where("_place <= _free")
        .groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group + item)])
        .agg(F.count("*").alias("_more"))
    )
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group + item)])
    return base.join(more, on, "left").select(*df.columns, (F.col("_few") + F.coalesce("_more", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row of docs(doc_id, text, source): doc_id, size, source_size, target, taken, and the columns in `keep`, whatever their names.

    Sources in order of code point (null last) weigh `weights`, repeating, and share as many words as there are; a
    target stops at `most` times its source. Blocks of `block` words go to sources by highest quotients of the targets,
    then to a source's shards (by hash of doc_id; sqrt(words / `shard`) of them) by highest quotients of their sizes. A
    shard's rows stand in the order of md5(seed, doc_id), rows without an id in that of their texts; its quota takes whole passes over it, then the blocks at its
    start, so `taken` is at most `most` times the size. Null or wordless texts have size 0 and are taken 0 times; equal
    rows count each; an empty table gives no row. Reruns agree: nothing depends on the partitions.

    Rows are shuffled twice without their texts: to sum sources (combined first) and into shards, which split a hot
    source; the plan per source and shard is small and joined to the rows.
    """
    text = F.coalesce("text", F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text)))
    rest = packed(("doc_id", *keep)).alias("rest")
    rows = docs.select(rest, F.col("source").alias("_source"), size_of(F.col("text")).alias("size"), F.md5(F.concat_ws(":", F.lit(seed), name)).alias("_key"), F.xxhash64("text").alias("_tie"))
    sizes = docs.select("source", size_of(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    plan = targets(ranked, weights, most).withColumn("one", F.lit(1))
    plan = apportioned(plan, ["one"], ["rank"], F.col("target"), F.round(F.col("total") / block))
    plan = plan.select(F.col("source").alias("_s"), "rank", "source_size", "target", F.col("quota").alias("blocks"), F.ceil(F.sqrt((F.col("source_size") + 1) / shard)).alias("shards"))

    dealt = rows.join(plan, rows["_source"].eqNullSafe(plan["_s"])).drop("_s")
    dealt = dealt.withColumn("shard", F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), F.col("shards")))
    per = dealt.groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.max("blocks").alias("blocks"))
    per = apportioned(per, ["rank"], ["shard"], F.col("words"), F.col("blocks")).select("rank", "shard", "words", F.least(F.col("quota") * block, F.col("words") * most).alias("due"))
    per = per.select(F.col("rank").alias("_r"), F.col("shard").alias("_h"), "words", "due")

    order = Window.partitionBy("rank", "shard").orderBy("_key", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    out = dealt.join(per, (F.col("rank") == F.col("_r")) & (F.col("shard") == F.col("_h")))
    passes = F.when(F.col("words") > 0, F.expr("due div words")).otherwise(F.lit(0))
    rest = F.when(F.col("words") > 0, F.expr("due % words")).otherwise(F.lit(0))
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    doc_id, *kept = unpacked("rest", ("doc_id", *keep))
    return out.select(doc_id, "size", "source_size", "target", taken.cast("long").alias("taken"), *kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
                  md5('{SEED}:' || coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))) as key from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as rank from s),
w as (select *, case rank % 3 when 0 then 5 when 1 then 2 else 1 end as weight, sum(source_size) over () as total from r),
c as (select *, 3 * source_size as cap, (3 * source_size)::double / weight as ratio from w),
l as (select *, (total - coalesce(sum(cap) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0))::double
               / (sum(weight) over (order by ratio, rank rows between current row and unbounded following))::double as level from c),
f as (select *, (select min_by(level, (ratio, rank)) from l where ratio >= level) as final from l),
t as (select source, rank, source_size, total, least(cap::double, coalesce(final, 0) * weight) as target from f),
q as (select rank, count(*) as blocks from (
        select rank, row_number() over (order by target / (2 * k + 1) desc, rank, k) as place, total
        from t, range((3 * source_size // {BLOCK} + 2)::bigint) as g(k)) where place <= round(total / {BLOCK}.0) group by rank),
p as (select t.*, coalesce(blocks, 0) as blocks, ceil(sqrt((source_size + 1) / {SHARD}.0))::bigint as shards from t left join q using (rank)),
e as (select d.*, rank, source_size, target, blocks, ('0x' || key[:8])::bigint % shards as shard from d join p on d.source is not distinct from p.source),
h as (select rank, shard, sum(size)::bigint as words, max(blocks) as blocks from e group by rank, shard),
a as (select rank, shard, count(*) as quota from (
        select rank, shard, row_number() over (partition by rank order by words::double / (2 * k + 1) desc, shard, k) as place, blocks
        from h, range((3 * words // {BLOCK} + 2)::bigint) as g(k)) where place <= blocks group by rank, shard),
u as (select h.rank, h.shard, words, least(coalesce(quota, 0) * {BLOCK}, words * 3) as due from h left join a using (rank, shard)),
v as (select *, coalesce(sum(size) over (partition by rank, shard order by key, size rows between unbounded preceding and 1 preceding), 0) as start from e)
select doc_id, size, source_size, target,
       (case when words > 0 then due // words * size + greatest(0, least(size, due % words - start)) else 0 end)::bigint as taken
from v join u using (rank, shard)
"""
QUERIES, SQL = {"op2_source_mix": query}, {"op2_source_mix": ORACLE}
