"""Queries of fingerprints of collections and digest trees over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fingerprints as fp
from ..operators import strata
from .catalog import SQL, add
from .fixtures import FIXTURES, read, sides_sql
from .more import _selected


def row_sql(*texts: str) -> str:
    """A row's digest, from its columns as text."""
    return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + ")"


def multiset_sql(digest: str) -> str:
    return "concat_ws(',', " + ", ".join(f"sum(('0x' || substr({digest}, {15 * i + 1}, 15))::bigint)::varchar" for i in range(fp.LANES)) + ")"


def tree_sql(levels: int) -> str:
    """CTEs n1 to n<levels> over a CTE n0 (node, rows, digest)."""
    return ", ".join(
        f"n{j} as (select node >> {fp.BITS} as node, sum(rows)::bigint as rows, sha256(string_agg(coalesce(node::varchar, '-') || ':' || digest, ',' order by node nulls first)) as digest from n{j - 1} group by 1)"
        for j in range(1, levels + 1)
    )


_BOXES = ["id", "l0", "l1", "u0", "u1"]
_BOX = row_sql(*[f"{c}::varchar" for c in _BOXES])


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides of both levels, each as one collection."""
    out = None
    for level in ("evt2_l1", "evt2_l2"):
        j = FIXTURES[level](spark, sf)
        for name, side in (("r", j.r), ("s", j.s)):
            df = side.select(F.lit(f"{level}/{name}").alias("collection"), *_BOXES)
            out = df if out is None else out.unionAll(df)
    return out


add("collection_fingerprints_events", lambda spark, sf: fp.fingerprints(_sides(spark, sf), _BOXES, ["collection"]), " union all ".join(
    f"(with {sides_sql(level)} select '{level}/{side}' as collection, count(*) as rows, {multiset_sql('h')} as fingerprint from (select {_BOX} as h from {side}))" for level in ("evt2_l1", "evt2_l2") for side in "rs"
))


def _levels(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """All boxes of each level; the parts' boxes have other ids."""
    return {name: (j := FIXTURES[name](spark, sf)).r.select("id").unionAll(j.s.select("id")) for name in ("evt2_l1", "evt2_l2", "part2")}


add("collections_share_ids", lambda spark, sf: fp.shared(_levels(spark, sf), ["id"]).select("collection", "rows", "same"), """with e as (select event_id as id from events), p as (select p_partkey as id from part),
d as (select count(*) as n from ((select * from e except all select * from p) union all (select * from p except all select * from e)))
select 'evt2_l1' as collection, (select count(*) from e) as rows, true as same union all select 'evt2_l2', (select count(*) from e), true union all select 'part2', (select count(*) from p), (select n = 0 from d)""")

_ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_cents", "o_orderdate", "o_orderpriority"]


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("o_cents"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")


_ORDERS = "o as (select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice * 100)::bigint as o_cents, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority from orders)"
_LEAF = f"select o_orderkey as node, count(*) as rows, sha256(count(*) || ';' || {multiset_sql('h')}) as digest from (select o_orderkey, {row_sql(*[f'{c}::varchar' for c in _ORDER])} as h from {{}}) group by 1"
add("digest_tree_orders", lambda spark, sf: fp.tree(fp.leaves(_orders(spark, sf), "o_orderkey"), 3), f"with {_ORDERS}, n0 as ({_LEAF.format('o')}), {tree_sql(3)} " + " union all ".join(f"select {j} as level, * from n{j}" for j in (1, 2, 3)))


def _altered(o: DataFrame) -> DataFrame:
    """Orders of which some are gone, some have another price and some have new keys."""
    return o.where("o_orderkey % 101 <> 0").withColumn("o_cents", F.expr("if(o_orderkey % 103 = 0, o_cents + 1, o_cents)")).withColumn("o_orderkey", F.expr("if(o_orderkey % 107 = 0, -o_orderkey, o_orderkey)"))


_ALTERED = "m as (select case when o_orderkey % 107 = 0 then -o_orderkey else o_orderkey end as o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 103 = 0 then o_cents + 1 else o_cents end as o_cents, o_orderdate, o_orderpriority from o where o_orderkey % 101 <> 0)"
_ROW = ", ".join(_ORDER[1:])
add(
    "changed_orders", lambda spark, sf: fp.changed(fp.leaves(_orders(spark, sf), "o_orderkey"), fp.leaves(_altered(_orders(spark, sf)), "o_orderkey")),
    f"""with {_ORDERS}, {_ALTERED}, a as (select o_orderkey as node, count(*) as n, list_sort(list(row({_ROW})::varchar)) as x from o group by 1), b as (select o_orderkey as node, count(*) as n, list_sort(list(row({_ROW})::varchar)) as x from m group by 1)
select node, case when a.n is null then 'added' when b.n is null then 'removed' else 'changed' end as change, a.n as rows_before, b.n as rows_after from a full join b using (node) where a.x is distinct from b.x""",
)
add(
    "changed_nodes_orders", lambda spark, sf: fp.changed(*(fp.tree(fp.leaves(o, "o_orderkey"), 3) for o in (_orders(spark, sf), _altered(_orders(spark, sf)))), on=("level", "node")),
    f"""with {_ORDERS}, {_ALTERED}, a as (select j::int as level, o_orderkey >> ({fp.BITS} * j)::int as node, count(*) as n, list_sort(list(row(o_orderkey, {_ROW})::varchar)) as x from o, (values (1), (2), (3)) t(j) group by 1, 2),
b as (select j::int as level, o_orderkey >> ({fp.BITS} * j)::int as node, count(*) as n, list_sort(list(row(o_orderkey, {_ROW})::varchar)) as x from m, (values (1), (2), (3)) t(j) group by 1, 2)
select level, node, case when a.n is null then 'added' when b.n is null then 'removed' else 'changed' end as change, a.n as rows_before, b.n as rows_after from a full join b using (level, node) where a.x is distinct from b.x""",
)

_MONTHS = "select user_id, month(ts) as month, cast(floor(value / 10) as bigint) as tx from events"
add(
    "selection_summary_events", lambda spark, sf: strata.selection_summary(read(spark, sf, "events").select("user_id", F.month("ts").alias("month"), strata.tile(F.col("value"), 10).alias("tx")), _selected(spark, sf), "user_id", ["month", "tx"]),
    " union all ".join(f"select '{n}' as part, count(*) as rows, count(distinct user_id) as users, count(distinct (month, tx)) as strata from ({q})" for n, q in (("candidates", _MONTHS), ("selected", SQL["stratified_select_events"]))),
)
