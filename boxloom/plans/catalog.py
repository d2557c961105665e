"""Queries over the fixtures by name, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import uniform_sql
from ..operators import boxes, decompose, joins, samplers, sweep, tiles
from .fixtures import DIMENSION, FIXTURES, overlap_sql, sides_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEED = "5eed" * 16


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _core(f: str) -> None:
    make, d, cte = FIXTURES[f], DIMENSION[f], sides_sql(f)

    def summary(spark, sf):
        j = make(spark, sf).clean()
        n = j.r.agg(F.count("*").alias("n_r")).crossJoin(j.s.agg(F.count("*").alias("n_s"))).crossJoin(joins.total_counted(j))
        return n.withColumn("alpha", F.col("w") / (F.col("n_r") + F.col("n_s")))

    add(f"box_grid_join_count_{f}", lambda spark, sf: joins.total_counted(make(spark, sf)), f"with {cte} select count(*) as w from p")
    add(f"box_summary_{f}", summary, f"with {cte}, c as (select (select count(*) from r) as n_r, (select count(*) from s) as n_s, (select count(*) from p) as w) select *, w / (n_r + n_s) as alpha from c")
    add(f"box_degree_{f}", lambda spark, sf: joins.degrees_counted(make(spark, sf)), f"with {cte} select r_id, count(*) as degree from p group by r_id")
    own = " + ".join(f"case when r_l{j} <= s_l{j} then {1 << j} else 0 end" for j in range(d))
    add(f"box_ownership_{f}", lambda spark, sf: joins.ownership_counted(make(spark, sf)), f"with {cte} select ({own})::bigint as own, count(*) as pairs from p group by 1")
    add(f"decomposed_count_{f}", lambda spark, sf: decompose.total_counted(make(spark, sf)), f"with {cte} select count(*) as w from p")
    last = d - 1
    anchor = f"case when r_l{last} <= s_l{last} then 0 else 1 end"
    add(
        f"anchor_weights_{f}", lambda spark, sf: decompose.anchors_counted(make(spark, sf)),
        f"with {cte}, a as (select {anchor} as anchor_side, r_id, s_id from p) select anchor_side, case when anchor_side = 0 then r_id else s_id end as anchor_id, count(*) as weight from a group by all",
    )
    later = "case when r_l0 > s_l0 then 0 else 1 end"
    add(
        f"sweep_weights_{f}", lambda spark, sf: sweep.weights(make(spark, sf)),
        f"with {cte}, a as (select {later} as side, r_id, s_id from p) select side, case when side = 0 then r_id else s_id end as id, count(*) as weight from a group by all",
    )


def blocks_sql(f: str) -> str:
    """CTE b: each pair with its place in the decomposition: the anchor's side, the canonical node of each leading axis, and what it meets on the last."""
    d = DIMENSION[f]
    last, ctes, nodes = d - 1, [], []
    for j in range(last):
        for x, y, below, to in (("r", "s", "<", "<"), ("s", "r", "<=", "<")):
            ctes.append(f"{x}{j} as (select id, lo, hi, rank from (select {x}.id, count(*) filter (where {y}.l{j} {below} {x}.l{j}) as lo, count(*) filter (where {y}.l{j} {to} {x}.u{j}) as hi from {x}, {y} group by {x}.id) join (select id, row_number() over (order by l{j}, id) - 1 as rank from {x}) using (id))")
        node = lambda lo, hi, rank: f"list_max(list_filter(range(0, 40), lambda h: (({rank} >> h::int) << h::int) >= {lo} and ((({rank} >> h::int) + 1) << h::int) <= {hi}))"
        first = f"r_l{j} <= s_l{j}"
        ctes.append(f"n{j} as (select r_id, s_id, {first} as o, case when {first} then {node(f'r{j}.lo', f'r{j}.hi', f's{j}.rank')} else {node(f's{j}.lo', f's{j}.hi', f'r{j}.rank')} end as h, case when {first} then s{j}.rank else r{j}.rank end as rank from p join r{j} on r{j}.id = r_id join s{j} on s{j}.id = s_id)")
        ctes.append(f"m{j} as (select r_id, s_id, (case when o then 0 else 1::bigint << 60 end) + (h << 50) + (rank >> h::int) as k{j} from n{j})")
        nodes.append(f"join m{j} using (r_id, s_id)")
    anchor = f"case when r_l{last} <= s_l{last} then 0 else 1 end"
    ctes.append(f"b as (select *, {anchor} as a from p {' '.join(nodes)})")
    return ", ".join(ctes)


def _samples(f: str, t: int = 1000) -> None:
    make, cte, d = FIXTURES[f], sides_sql(f), DIMENSION[f]
    last, keys = d - 1, [f"k{j}" for j in range(d - 1)]

    def drawn(kind: str):
        return lambda spark, sf: samplers.make_sampler(kind, make(spark, sf), SEED).sample(t)

    def of(side: str, c: str) -> str:
        """A column of the R box where `side` is 0, else of the S box."""
        return f"case when {side} = 0 then r_{c} else s_{c} end"

    def sql(kind: str, order: list[str]) -> str:
        g = uniform_sql(f"{SEED}:{kind}", "pos", "w")
        return f"""
with {cte}, {blocks_sql(f)}, o as (select *, row_number() over (order by {", ".join(order)}) - 1 as place from b),
d as (select pos, {g} as g from range({t}) x(pos), (select count(*) as w from p))
select pos, r_id, s_id from d join o on g = place"""

    def owned(side: str) -> list[str]:
        """An owner's pairs: by its own blocks, then by others', each group by group; partners by lower end, or by upper end."""
        partner, own = f"(1 - ({side}))", f"case when a = {side} then 0 else 1 end"
        return [of(side, "id"), side, own, *keys, f"case when a = {side} then {of(partner, f'l{last}')} else {of(partner, f'u{last}')} end", of(partner, "id")]

    later = "(case when r_l0 > s_l0 then 0 else 1 end)"
    listed = [of("(1 - a)", f"l{last}"), of("(1 - a)", "id")]
    add(f"sample_{f}_lifted", drawn("lifted"), sql("lifted", owned("0")))
    add(f"sample_{f}_sweep", drawn("sweep"), sql("sweep", owned(later)))
    add(f"sample_{f}_compiled", drawn("compiled"), sql("compiled", [of("a", "id"), "a", *keys, *listed]))
    add(f"sample_{f}_replay", drawn("replay"), sql("replay", [*keys, "a", *([of("a", "l0")] if d == 1 else []), of("a", "id"), *listed]))

    def membership(kind: str):
        def run(spark, sf):
            j = make(spark, sf)
            s = samplers.make_sampler(kind, j, SEED).sample(t)
            wrong = joins.invalid_pairs(j, s)
            return s.agg(F.count("*").alias("samples"), F.countDistinct("pos").alias("positions")).crossJoin(wrong.agg(F.count("*").alias("invalid")))

        return run

    for kind in samplers.KINDS:
        add(f"sample_members_{f}_{kind}", membership(kind), f"with {cte} select case when count(*) > 0 then {t} else 0 end as samples, case when count(*) > 0 then {t} else 0 end as positions, 0 as invalid from p")


for _f in FIXTURES:
    _core(_f)
for _f in ("ord1", "ord_all", "part2", "evt2_l1", "emb3"):
    _samples(_f)

for _f in ("ord1", "ord_all", "part2", "evt2_l1", "emb2"):
    _d, _cte = DIMENSION[_f], sides_sql(_f)
    add(f"box_join_pairs_{_f}", lambda spark, sf, f=_f: joins.pairs(tiles.overlapping(FIXTURES[f](spark, sf))), f"with {_cte} select r_id, s_id from p")
    add(f"box_theta_join_count_{_f}", lambda spark, sf, f=_f: joins.theta_total(FIXTURES[f](spark, sf)), f"with {_cte} select count(*) as w from p")
    _closed = " and ".join(f"r.l{j} <= s.u{j} and s.l{j} <= r.u{j}" for j in range(_d))
    add(f"box_touch_pairs_{_f}", lambda spark, sf, f=_f: joins.touching_pairs(FIXTURES[f](spark, sf)), f"with {_cte} select r.id as r_id, s.id as s_id from r join s on {_closed} where not ({overlap_sql(_d)})")
    _extent = ", ".join(f"{g}({c}) as {g}_{c}" for j in range(_d) for c in (f"l{j}", f"u{j}") for g in ("min", "max"))
    add(f"box_extent_{_f}", lambda spark, sf, f=_f: boxes.extent(FIXTURES[f](spark, sf).r), f"with {_cte} select count(*) as n, {_extent} from r")
    add(
        f"sweep_events_{_f}", lambda spark, sf, f=_f: sweep.swept(FIXTURES[f](spark, sf)),
        f"""with {_cte}, e as (select l0 as coord, 0 as is_end, 0 as side, id from r union all select u0, 1, 0, id from r union all select l0, 0, 1, id from s union all select u0, 1, 1, id from s)
select *, row_number() over w - 1 as place, coalesce(sum(1 - is_end) over b, 0)::bigint as starts_before,
       coalesce(sum(case when side = 0 then 1 - 2 * is_end else 0 end) over b, 0)::bigint as active_r, coalesce(sum(case when side = 1 then 1 - 2 * is_end else 0 end) over b, 0)::bigint as active_s
from e window w as (order by coord, is_end desc, side, id), b as (order by coord, is_end desc, side, id rows between unbounded preceding and 1 preceding)""",
    )

_touch = lambda a, b, o: f"(select count(*) from r join s on r.{a} = s.{b} and r.l{o} <= s.u{o} and s.l{o} <= r.u{o})"
_corner = " + ".join(f"(select count(*) from r join s on r.{rx} = s.{sx} and r.{ry} = s.{sy})" for rx, sx in (("u0", "l0"), ("l0", "u0")) for ry, sy in (("u1", "l1"), ("l1", "u1")))
for _f in ("part2", "evt2_l1", "emb2"):
    add(
        f"box_contact_counts_{_f}", lambda spark, sf, f=_f: joins.contact_counts(FIXTURES[f](spark, sf)),
        f"""with {sides_sql(_f)}, c as (select {_touch("u0", "l0", 1)} as a, {_touch("l0", "u0", 1)} as b, {_touch("u1", "l1", 0)} as c, {_touch("l1", "u1", 0)} as d, {_corner} as e)
select 'x_upper_lower' as contact, a as n from c union all select 'x_lower_upper', b from c union all select 'y_upper_lower', c from c union all select 'y_lower_upper', d from c
union all select 'corner', e from c union all select 'all', a + b + c + d - e from c""",
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_r, n_s, W and density of evt2_l1, by the decomposition."""
    j = FIXTURES["evt2_l1"](spark, sf_dir).clean()
    n = j.r.agg(F.count("*").alias("n_r")).crossJoin(j.s.agg(F.count("*").alias("n_s"))).crossJoin(decompose.total(decompose.atoms(j)[0]))
    return n.withColumn("alpha", F.col("w") / (F.col("n_r") + F.col("n_s")))
