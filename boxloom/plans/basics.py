"""Queries of single predicates, diagnostics and relations between collections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import uniform_sql
from ..operators import boxes, decompose, diagnostics, joins, ranges, strata, sweep
from .catalog import SEED, SQL, blocks_sql, add
from .fixtures import FIXTURES, read, sides_sql


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part")


add("box_middle_part", lambda spark, sf: _parts(spark, sf).select("p_partkey", boxes.middle(F.expr("cast(p_size - p_partkey % 7 as bigint)"), F.expr("cast(p_size + p_partkey % 7 as bigint)")).alias("center")), "select p_partkey, p_size::bigint as center from part")
add(
    "box_slab_part", lambda spark, sf: boxes.slab(_parts(spark, sf).withColumn("x1", F.col("p_size") + 3).withColumn("y1", F.col("p_retailprice") + 2), "p_partkey", ("p_size", "x1"), ("p_retailprice", "y1"), "p_size"),
    "select p_partkey as id, p_size::double as l0, p_retailprice::double as l1, p_size::double as l2, (p_size + 3)::double as u0, p_retailprice::double + 2 as u1, p_size::double + 1 as u2 from part",
)
add("box_nonempty_part", lambda spark, sf: boxes.boxes(_parts(spark, sf), "p_partkey", [F.lit(20).cast("bigint")], [F.col("p_size").cast("bigint")]).where(boxes.nonempty(1)).select("id"), "select p_partkey as id from part where p_size > 20")
add("repeated_box_ids_lineitem", lambda spark, sf: boxes.repeated_ids(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))), "select l_orderkey as id, count(*) as copies from lineitem group by 1 having count(*) > 1")


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    """The block of parts of one size against the range around each part of that size."""
    p = _parts(spark, sf).withColumn("x", F.col("p_size").cast("double"))
    ends = lambda c: [F.min(c), F.max(c)]
    (a, b), (c, d) = ends("x"), ends("p_retailprice")
    blocks = p.groupBy("p_size").agg(a.alias("min0"), b.alias("max0"), c.alias("min1"), d.alias("max1"))
    asked = p.selectExpr("p_partkey as qid", "p_size", "x - p_partkey % 3 as lo0", "if(p_partkey % 5 = 0, null, x + 1) as hi0", "p_retailprice - 400 * (p_partkey % 4) as lo1", "p_retailprice + 300 * (p_partkey % 6) as hi1",
                         "p_partkey % 2 = 0 as lo0_strict", "false as hi0_strict", "true as lo1_strict", "false as hi1_strict")
    return asked.join(blocks, "p_size").select("qid", ranges.relation(2).alias("relation"))


add(
    "range_relation_part", _relations,
    """with b as (select p_size, min(p_size)::double as x, min(p_retailprice) as y0, max(p_retailprice) as y1 from part group by 1),
q as (select p_partkey as qid, p_size, p_size - p_partkey % 3 as lo0, case when p_partkey % 5 = 0 then null else p_size + 1 end as hi0, p_retailprice - 400 * (p_partkey % 4) as lo1, p_retailprice + 300 * (p_partkey % 6) as hi1, p_partkey % 2 = 0 as strict from part),
c as (select *, case when strict then x > lo0 else x >= lo0 end and (hi0 is null or x <= hi0) as fits from q join b using (p_size))
select qid, case when not fits or y1 <= lo1 or y0 > hi1 then 'outside' when y0 > lo1 and y1 <= hi1 then 'inside' else 'partial' end as relation from c""",
)
for _f in ("part2", "evt2_l1"):
    add(
        f"node_weights_{_f}", lambda spark, sf, f=_f: decompose.node_weights(decompose.atoms(FIXTURES[f](spark, sf))[0]).groupBy(F.call_function("div", F.col("k0"), F.lit(1 << 60).cast("bigint")).alias("starts_later")).agg(F.sum("weight").alias("pairs")),
        f"with {sides_sql(_f)} select (r_l0 > s_l0)::bigint as starts_later, count(*) as pairs from p group by 1",
    )
for _f in ("part2", "evt2_l1", "emb3"):
    add(f"node_pairs_{_f}", lambda spark, sf, f=_f: decompose.node_weights(decompose.atoms(FIXTURES[f](spark, sf))[0]), f"with {sides_sql(_f)}, {blocks_sql(_f)} select k0, count(*) as weight from b group by 1")
for _f, _d in (("ord1", 1), ("ord_all", 1), ("part2", 2), ("evt2_l1", 2), ("emb3", 3)):
    add(f"box_degree_counted_{_f}", lambda spark, sf, f=_f: joins.degrees_counted(FIXTURES[f](spark, sf)), SQL.get(f"box_degree_{_f}"))

# the plane sweep by strips
for _f in ("ord1", "part2", "evt2_l1", "emb3"):
    add(f"strip_pairs_{_f}", lambda spark, sf, f=_f: sweep.strip_pairs(FIXTURES[f](spark, sf), 2000), f"with {sides_sql(_f)} select r_id, s_id from p")
    add(f"strip_weights_{_f}", lambda spark, sf, f=_f: sweep.strip_weights(FIXTURES[f](spark, sf), 2000), SQL[f"sweep_weights_{_f}"])

# exact quantiles and sums, rounded where the last digit depends on the order of operations
_at = ((0.0, "q0"), (0.5, "q50"), (0.9, "q90"), (1.0, "q100"))
add(
    "quantiles_part", lambda spark, sf: (q := strata.quantiles(_parts(spark, sf), ["p_size"], "p_retailprice")).select("p_size", *[F.round(n, 6).alias(n) for _, n in _at]),
    f"select p_size, {', '.join(f'round(quantile_cont(p_retailprice, {a}), 6) as {n}' for a, n in _at)} from part group by 1",
)
_measures = {"length0": "(u0 - l0) / w0", "length1": "(u1 - l1) / w1", "volume": "(u0 - l0) / w0 * ((u1 - l1) / w1)", "log_volume": "ln((u0 - l0) / w0 * ((u1 - l1) / w1))", "aspect": "greatest((u0 - l0) / w0, (u1 - l1) / w1) / least((u0 - l0) / w0, (u1 - l1) / w1)"}
_quantile = ", ".join(f"round(quantile_cont(v, {a}), 6) as p{round(100 * a)}" for a in (0.5, 0.9, 0.95, 0.99))
add(
    "shape_quantiles_part2", lambda spark, sf: (q := diagnostics.shape_quantiles(FIXTURES["part2"](spark, sf).r)).select("measure", *[F.round(c, 6).alias(c) for c in q.columns[1:]]),
    f"with {sides_sql('part2')}, w as (select *, (select max(u0) - min(l0) from r) as w0, (select max(u1) - min(l1) from r) as w1 from r), m as ({' union all '.join(f'select {chr(39)}{k}{chr(39)} as measure, {v} as v from w' for k, v in _measures.items())}) select measure, {_quantile} from m group by 1",
)
add("exact_sum_part", lambda spark, sf: spark.createDataFrame([(round(diagnostics.exact_sum(_parts(spark, sf), "p_retailprice") / 2**1074, 4),)], "total double"), "select round(fsum(p_retailprice), 4) as total from part")


def _months(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    day = lambda c: F.datediff(c, F.lit("1970-01-01")).cast("bigint")
    o = read(spark, sf, "orders").select(day(F.col("o_orderdate")).alias("z"), "o_orderkey", F.trunc("o_orderdate", "month").alias("month"))
    return o.select("z", "o_orderkey"), o.select("month").distinct().select(day(F.col("month")).alias("start"), day(F.add_months("month", 1)).alias("end"))


add("stab_orders", lambda spark, sf: joins.stab(*_months(spark, sf)), "with d as (select o_orderkey, o_orderdate::date as day from orders) select date_diff('day', date '1970-01-01', day)::bigint as z, o_orderkey, date_diff('day', date '1970-01-01', date_trunc('month', day)::date)::bigint as start, date_diff('day', date '1970-01-01', (date_trunc('month', day) + interval 1 month)::date)::bigint as \"end\" from d")

# relations between collections
_keys = lambda spark, sf, t, c: read(spark, sf, t).select(F.col(c).alias("key"))
add("set_intersection_customers", lambda spark, sf: _keys(spark, sf, "customer", "c_custkey").intersect(_keys(spark, sf, "orders", "o_custkey")), "select c_custkey as key from customer intersect select o_custkey from orders")
add("set_difference_customers", lambda spark, sf: _keys(spark, sf, "customer", "c_custkey").subtract(_keys(spark, sf, "orders", "o_custkey")), "select c_custkey as key from customer except select o_custkey from orders")
_both = lambda spark, sf: read(spark, sf, "orders").select(F.lit("R").alias("side"), F.col("o_custkey").alias("key")).unionAll(read(spark, sf, "customer").select(F.lit("S"), F.col("c_custkey"))).distinct()
add("shared_ids_customers", lambda spark, sf: strata.shared_ids(_both(spark, sf), "side", "key"), "with b as (select distinct 'R' as side, o_custkey as key from orders union all select distinct 'S', c_custkey from customer) select side, key, dense_rank() over (order by key) - 1 as object_id from b")
_centers = lambda f: f"select id, (l0 + u0 - 1) // 2 as c0, (l1 + u1 - 1) // 2 as c1 from {f}"


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of two levels have the same ids and centers; those of different sides don't."""
    at = lambda f, side: getattr(FIXTURES[f](spark, sf), side).selectExpr("id", "(l0 + u0 - 1) div 2 as c0", "(l1 + u1 - 1) div 2 as c1")
    pairs = [("levels", at("evt2_l1", "r"), at("evt2_l2", "r")), ("sides", at("evt2_l1", "r"), at("evt2_l1", "s"))]
    rows = [boxes.differences(a, b).select(F.lit(name).alias("what"), "*") for name, a, b in pairs]
    return rows[0].unionAll(rows[1])


_evt = {x: sides_sql(f"evt2_{x}").split(", p as")[0].replace("r as", f"r_{x} as", 1).replace(", s as", f", s_{x} as", 1) for x in ("l1", "l2")}
_left = lambda a, b: f"(select count(*) from ({_centers(a)} except all {_centers(b)}))"
add("collection_differences_events", _levels, f"with {_evt['l1']}, {_evt['l2']} select 'levels' as what, {_left('r_l1', 'r_l2')} as only_first, {_left('r_l2', 'r_l1')} as only_second union all select 'sides', {_left('r_l1', 's_l1')}, {_left('s_l1', 'r_l1')}")
