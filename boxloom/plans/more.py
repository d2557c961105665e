"""Queries of ranges, changing point sets, stratified selection, run records and validation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import VERSION, canonical_integers, stable_hex
from ..functions.random import uniform_sql
from ..operators import diagnostics, ranges, records, samplers, strata, tiles, validation
from .catalog import SEED, SQL, add
from .fixtures import FIXTURES, read, sides_sql


def stable_sql(tag: str, *fields: str) -> str:
    joined = " || ',' || ".join(fields)
    return f"""sha256('{{"fields":[' || {joined} || '],"tag":"{tag}","version":"{VERSION}"}}')"""


def array_sql(*cols: str) -> str:
    return "'[' || " + " || ',' || ".join(f"{c}::varchar" for c in cols) + " || ']'"


# ranges over parts: size and price, around every tenth part
_RANGES = [
    "p_partkey as qid", "p_size - 5 as lo0", "case when p_partkey % 30 = 0 then null else p_size + 5 end as hi0", "p_retailprice - 20 as lo1",
    "case when p_partkey % 70 = 0 then p_retailprice - 20 else p_retailprice + 20 end as hi1", "p_partkey % 20 = 0 as lo0_strict", "p_partkey % 40 = 0 as hi0_strict", "p_partkey % 20 = 0 as lo1_strict", "false as hi1_strict",
]
_RANGE = ", ".join(_RANGES)


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").selectExpr("p_partkey as id", "cast(p_size as double) as x0", "p_retailprice as x1")


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").where("p_partkey % 10 = 0").selectExpr(*_RANGES)


_INSIDE = " and ".join(f"(lo{j} is null or x{j} > lo{j} or (x{j} = lo{j} and not lo{j}_strict)) and (hi{j} is null or x{j} < hi{j} or (x{j} = hi{j} and not hi{j}_strict))" for j in (0, 1))
_CTE = f"pts as (select p_partkey as id, p_size::double as x0, p_retailprice as x1 from part), q as (select {_RANGE} from part where p_partkey % 10 = 0), m as (select qid, id from q join pts on {_INSIDE})"
add("range_count_part", lambda spark, sf: ranges.range_count(_points(spark, sf), _ranges(spark, sf), 2), f"with {_CTE} select qid, count(id) as n from q left join m using (qid) group by qid")
add("range_count_scan_part", lambda spark, sf: ranges.range_count(_points(spark, sf), _ranges(spark, sf), 2), SQL["range_count_part"])
add("range_empty_part", lambda spark, sf: _ranges(spark, sf).select("qid", ranges.provably_empty(2).alias("empty")), f"with {_CTE} select qid, coalesce(lo0 > hi0 or (lo0 = hi0 and (lo0_strict or hi0_strict)), false) or coalesce(lo1 > hi1 or (lo1 = hi1 and (lo1_strict or hi1_strict)), false) as empty from q")
add(
    "range_sample_part", lambda spark, sf: ranges.range_sample(_points(spark, sf), _ranges(spark, sf), 2, 5, SEED, 10.0),
    f"with {_CTE}, k as (select *, row_number() over (partition by qid order by id) - 1 as place, count(*) over (partition by qid) as n from m), "
    f"d as (select distinct qid, pos::int as pos, {uniform_sql(SEED, "qid::varchar || ':' || pos", 'n')} as place from (select distinct qid, n from k), range(5) x(pos)) select qid, pos, id from d join k using (qid, place)",
)
add(
    "range_draws_part", lambda spark, sf: ranges.range_draws(_points(spark, sf), _ranges(spark, sf), 2, 5, SEED),
    f"with {_CTE}, k as (select qid, id, row_number() over (partition by qid order by x1, id) - 1 as place, count(*) over (partition by qid) as n from m join pts using (id)), "
    f"d as (select distinct qid, pos::int as pos, {uniform_sql(SEED, "qid::varchar || ':' || pos", 'n')} as place from (select distinct qid, n from k), range(5) x(pos)) select qid, pos, id from d join k using (qid, place)",
)


# ranges of three axes over orders (customer, price, day), one for each customer
def _priced(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").selectExpr("o_orderkey as id", "cast(o_custkey as double) as x0", "o_totalprice as x1", "cast(datediff(o_orderdate, date '1970-01-01') as double) as x2")


_CUBES = ["c_custkey as qid", "cast(c_custkey as double) as lo0", "cast(c_custkey + 200 as double) as hi0", "c_acctbal * 10 as lo1", "case when c_custkey % 3 = 0 then null else c_acctbal * 10 + 60000 end as hi1", "cast(9000 + c_custkey % 1000 as double) as lo2", "cast(9400 + c_custkey % 1000 as double) as hi2",
          *[f"c_custkey % {2 + j} = 0 as {e}{j}_strict" for j in range(3) for e in ("lo", "hi")]]
_CUBE_SQL = ", ".join(x.replace("cast(", "(").replace(" as double)", ")::double") for x in _CUBES)
_IN3 = " and ".join(f"(lo{j} is null or x{j} > lo{j} or (x{j} = lo{j} and not lo{j}_strict)) and (hi{j} is null or x{j} < hi{j} or (x{j} = hi{j} and not hi{j}_strict))" for j in range(3))
add(
    "range_count_orders", lambda spark, sf: ranges.range_count(_priced(spark, sf), read(spark, sf, "customer").selectExpr(*_CUBES), 3),
    f"with pts as (select o_orderkey as id, o_custkey::double as x0, o_totalprice as x1, date_diff('day', date '1970-01-01', o_orderdate::date)::double as x2 from orders), q as (select {_CUBE_SQL} from customer) select qid, count(id) as n from q left join pts on {_IN3} group by qid",
)


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").selectExpr("event_id as seq", "user_id as id", "case when event_type = 'error' then -1 else 1 end as delta")


def _moments(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").where("event_id % 97 = 0").selectExpr("event_id as qid", "event_id as seq", "cast(event_id % 40 as double) as lo0", "cast(event_id % 40 + 30 as double) as hi0", "event_id % 2 = 0 as lo0_strict", "true as hi0_strict")


def _users(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").selectExpr("user_id as id", "cast(user_id as double) as x0").distinct()


_LOG = "g as (select event_id as seq, user_id as id, case when event_type = 'error' then -1 else 1 end as delta from events)"
_ASOF = f"{_LOG}, q as (select event_id as qid, event_id as seq, (event_id % 40)::double as lo0, (event_id % 40 + 30)::double as hi0, event_id % 2 = 0 as strict from events where event_id % 97 = 0), l as (select qid, id, max_by(delta, g.seq) as delta from q join g on g.seq <= q.seq group by qid, id), a as (select qid, id from l where delta = 1)"
add("range_active_count", lambda spark, sf: ranges.active_range_count(_users(spark, sf), _log(spark, sf), _moments(spark, sf), 1), f"with {_ASOF} select q.qid, count(a.id) as n from q left join a on a.qid = q.qid and a.id < hi0 and (a.id > lo0 or (a.id = lo0 and not strict)) group by q.qid")
add("active_at", lambda spark, sf: ranges.active_at(_log(spark, sf), _moments(spark, sf)), f"with {_ASOF} select qid, id from a")
add("activity_errors", lambda spark, sf: ranges.activity_errors(_log(spark, sf)), f"with {_LOG}, w as (select *, lag(delta, 1, -1) over (partition by id order by seq) as before from g) select seq, id, delta from w where before = delta")


# stratified selection
def _tiled(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", F.col("p_size").alias("kind"), strata.tile(F.col("p_retailprice"), 100).alias("tx"), strata.tile(-F.col("p_retailprice"), 300).alias("ty"))


def _half(spark: SparkSession, sf: str) -> DataFrame:
    df = _tiled(spark, sf)
    return strata.half_split(df, ["kind", "tx", "ty"], "p_partkey", df.count() // 2)


_TILED = "t as (select p_partkey, p_size as kind, floor(p_retailprice / 100)::bigint as tx, floor(-p_retailprice / 300)::bigint as ty from part)"
add(
    "split_half_part", _half,
    f"""with {_TILED}, z as (select kind, tx, ty, count(*) as n from t group by all), o as (select *, sum(n % 2) over (order by {stable_sql(strata.STRATUM_TAG, array_sql('kind', 'tx', 'ty'))}, kind, tx, ty) as place, (select count(*) // 2 from t) - sum(n // 2) over () as missing from z),
u as (select kind, tx, ty, n // 2 + case when n % 2 = 1 and place <= missing then 1 else 0 end as quota from o), k as (select *, row_number() over (partition by kind, tx, ty order by {stable_sql(strata.OBJECT_TAG, 'p_partkey::varchar')}, p_partkey) as i from t)
select p_partkey, kind, tx, ty, case when i <= quota then 'R' else 'S' end as side from k join u using (kind, tx, ty)""",
)
add("tile_sizes_part", lambda spark, sf: _tiled(spark, sf).groupBy("kind", "tx", "ty").agg(F.count("*").alias("n")), f"with {_TILED} select kind, tx, ty, count(*) as n from t group by all")
add("split_users_events", lambda spark, sf: strata.alternate_users(read(spark, sf, "events"), "user_id"), f"with u as (select distinct user_id from events) select user_id, case when (row_number() over (order by {stable_sql(strata.USER_TAG, 'user_id::varchar')}, user_id) - 1) % 2 = 0 then 'R' else 'S' end as side from u")
add(
    "largest_remainder_nation", lambda spark, sf: strata.largest_remainder(read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("size")), "size", 77, ["c_nationkey"]),
    "with s as (select c_nationkey, count(*) as size from customer group by 1), f as (select *, 77 * size // sum(size) over () as base, 77 * size % sum(size) over () as rest from s), r as (select *, row_number() over (order by rest desc, c_nationkey) as place, 77 - sum(base) over () as missing from f) select c_nationkey, size, (base + case when place <= missing then 1 else 0 end)::bigint as quota from r",
)


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_id", "user_id", F.month("ts").cast("bigint").alias("month"), strata.tile(F.col("value"), 10).alias("tx"))
    sided = e.join(strata.alternate_users(e, "user_id"), "user_id").withColumn("priority", F.sha2(F.col("event_id").cast("string"), 256))
    return strata.stratified_select(sided, "side", ["month", "tx"], ["priority", "event_id"], 100).drop("priority")


add(
    "stratified_select_events", _selected,
    f"""with u as ({SQL["split_users_events"]}), e as (select event_id, user_id, month(ts)::bigint as month, floor(value / 10)::bigint as tx, side, sha256(event_id::varchar) as priority from events join u using (user_id)),
s as (select side, month, tx, count(*) as size from e group by all), f as (select *, 100 * size // sum(size) over (partition by side) as base, 100 * size % sum(size) over (partition by side) as rest from s),
r as (select *, row_number() over (partition by side order by rest desc, {stable_sql(strata.QUOTA_TAG, "'\"' || side || '\"'", array_sql('month', 'tx'))}, month, tx) as place, 100 - sum(base) over (partition by side) as missing from f),
q as (select side, month, tx, base + case when place <= missing then 1 else 0 end as quota from r), k as (select *, row_number() over (partition by side, month, tx order by priority, event_id) as i from e)
select user_id, event_id, month, tx, side from k join q using (side, month, tx) where i <= quota""",
)
add("rank_ids_orders", lambda spark, sf: strata.rank_ids(read(spark, sf, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority", "o_orderkey"]), "select o_orderpriority, o_orderkey, row_number() over (order by o_orderpriority, o_orderkey) - 1 as object_id from orders")
add("repeated_ids_lineitem", lambda spark, sf: strata.repeats(read(spark, sf, "lineitem"), "l_orderkey"), "with n as (select count(*) as n from lineitem group by l_orderkey) select count(*) as distinct_keys, count(*) filter (where n > 1) as repeated_keys, sum(n - 1)::bigint as excess_rows, max(n) as most from n")
add("lowest_hashes_orders", lambda spark, sf: strata.lowest_hashes(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), [F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")], 50, strata.IMAGE_TAG, ["o_orderkey"]), f"select o_orderkey, o_custkey from orders order by {stable_sql(strata.IMAGE_TAG, 'o_custkey::varchar', 'o_orderkey::varchar')}, o_orderkey limit 50")
add("halves_within_orders", lambda spark, sf: strata.halves_within(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], [F.col("o_orderkey").cast("string")], 100, strata.PROPOSAL_TAG, ["o_orderkey"]), f"select o_orderkey, o_orderstatus, case when row_number() over (partition by o_orderstatus order by {stable_sql(strata.PROPOSAL_TAG, 'o_orderkey::varchar')}, o_orderkey) <= 100 then 'R' else 'S' end as side from orders")
add("stable_hash_part", lambda spark, sf: read(spark, sf, "part").select("p_partkey", stable_hex("tag", canonical_integers(F.col("p_partkey"), F.col("p_size"))).alias("h")), f"select p_partkey, {stable_sql('tag', array_sql('p_partkey', 'p_size'))} as h from part")

# diagnostics of relations
for _f, _d in (("part2", 2), ("evt2_l1", 2)):
    _pts = " union all ".join(f"select {j} as axis, {e}{j} as v from r" for j in range(_d) for e in "lu")
    add(f"duplicate_endpoints_{_f}", lambda spark, sf, f=_f: diagnostics.duplicate_endpoints(FIXTURES[f](spark, sf).r), f"with {sides_sql(_f)}, e as ({_pts}) select axis, 1 - count(distinct v) / count(*) as fraction from e group by axis")
    _touch = " union all ".join(f"select {j} as axis, count(*) filter (where l{j} = lo or u{j} = hi) / count(*) as fraction from r, (select min(l{j}) as lo, max(u{j}) as hi from r)" for j in range(_d))
    add(f"boundary_fraction_{_f}", lambda spark, sf, f=_f: diagnostics.boundary_fraction(FIXTURES[f](spark, sf).r), f"with {sides_sql(_f)} {_touch}")

# run records: 4 algorithms x modes and tasks x 3 values of x, with failures and one wrong count
_RECORD = """'m' as machine_id, 'c' as code_commit, 'b' as build_sha256, 'e' as experiment_config_sha256, 'a' as algorithm_config_sha256, concat('w', i div 12) as workload_config_sha256,
 concat('g', i div 2) as run_group_id, case i % 2 when 0 then 'time' else 'memory' end as measurement_mode, 'oneshot' as task, case (i div 2) % 4 when 0 then 'AC' when 1 then 'AS' when 2 then 'SweepRT' else 'LiftedRT' end as algorithm,
 'exp' as experiment_id, 'synthetic' as dataset_type, 'd' as dataset_id, concat('x', i div 8) as workload_id, concat('h', i div 8) as workload_sha256, cast(null as string) as subset_id, 'N' as sweep, 'N' as x_name, cast(null as string) as level,
 case when i % 48 in (30, 31) then 'OOM' when i % 48 = 44 then 'TO' when i % 48 in (16, 17, 18, 19, 20, 21, 22, 23) then 'EMPTY-JOIN' else 'OK' end as status, case when i % 48 = 3 then '18' when i % 48 in (30, 31, 44) then null else '17' end as W,
 cast(1000 as bigint) as t, cast(0 as bigint) as data_seed, cast(0 as bigint) as sample_seed_id, cast(0 as bigint) as process_repeat_id, cast(case when i % 48 = 36 then 999 else 1000 end as bigint) as output_length, cast(i div 8 as double) as x_value,
 cast(case when i % 2 = 0 then 1 + i end as double) as OneShotTime, cast(case when i % 2 = 0 then 2 + i % 5 end as double) as QueryTime, cast(case when i % 2 = 1 then 100 + i end as double) as PeakMemoryTotal"""


def run_records(spark: SparkSession, sf: str | None = None) -> DataFrame:
    """A record for each order, by its key; 48 without a folder of tables."""
    numbers = spark.range(48).withColumnRenamed("id", "i") if sf is None else read(spark, sf, "orders").selectExpr("o_orderkey as i")
    numbers.createOrReplaceTempView("boxloom_record_numbers")
    return spark.sql(f"select {_RECORD} from boxloom_record_numbers")


_R = f"n as (select {_RECORD.replace('i div 12', 'i // 12').replace('i div 2', 'i // 2').replace('i div 8', 'i // 8').replace('as string', 'as varchar')} from (select o_orderkey as i from orders))"
_REC = f"""{_R}, o as (select *, (count(distinct case when status in ('OK', 'EMPTY-JOIN') then W end) over (partition by workload_id) > 1 or count(*) filter (where status in ('OK', 'EMPTY-JOIN') and W is null) over (partition by workload_id) > 0) and status in ('OK', 'EMPTY-JOIN') as bad_w,
 count(distinct coalesce(status, '')) over (partition by run_group_id) > 1 or count(distinct output_length) over (partition by run_group_id) > 1 as bad_m from n),
r as (select * replace (case when bad_w then 'COUNT-MISMATCH' else status end as status), status as was, not bad_w and not bad_m as admitted from o)"""
_BASE = ", ".join(records.BASE)
_reconciled = lambda spark, sf: records.reconciled(run_records(spark, sf))
add("records_reconciled", lambda spark, sf: _reconciled(spark, sf).select("run_group_id", "measurement_mode", "status", "original_status", "consistency_admitted", "count_consistency_checked"),
    f"with {_REC} select run_group_id, measurement_mode, status, case when bad_w then was end as original_status, admitted as consistency_admitted, admitted and was in ('OK', 'EMPTY-JOIN') and W is not null as count_consistency_checked from r")
_mode = "case when metric = 'PeakMemoryTotal' then 'memory' else 'time' end"
add("records_metrics_long", lambda spark, sf: records.metrics_long(_reconciled(spark, sf)),
    f"with {_REC}, l as (select {_BASE}, metric, data_seed, value, measurement_mode from (select *, unnest(['OneShotTime', 'QueryTime', 'PeakMemoryTotal']) as metric, unnest([OneShotTime, QueryTime, PeakMemoryTotal]) as value from r where status = 'OK' and admitted)) select {_BASE}, metric, data_seed, value from l where value is not null and measurement_mode = {_mode}")
add("records_speedups", lambda spark, sf: records.speedups(_reconciled(spark, sf)),
    f"with {_REC}, t as (select * from r where status = 'OK' and admitted and measurement_mode = 'time' and OneShotTime > 0) select t.experiment_id, t.dataset_type, t.dataset_id, t.sweep, t.x_name, t.x_value, t.t, t.level, t.data_seed, t.algorithm, b.algorithm as baseline, b.OneShotTime / t.OneShotTime as speedup from t join t b on b.workload_id = t.workload_id and b.x_value = t.x_value and b.algorithm in ('LiftedRT', 'SweepRT') and b.algorithm <> t.algorithm")
add("records_status_summary", lambda spark, sf: records.status_summary(_reconciled(spark, sf)), f"with {_REC} select {_BASE}, measurement_mode, task, status, count(*) as runs from r group by all")
add("records_count_consistency", lambda spark, sf: records.count_consistency(run_records(spark, sf)).withColumn("counts", F.array_join("counts", ";")), f"with {_R} select dataset_id, workload_id, string_agg(distinct W, ';' order by W) as counts, count(distinct W) = 1 as consistent from n where status in ('OK', 'EMPTY-JOIN') and W is not null group by all")
_differ = lambda c: f"max(coalesce({c}::varchar, '')) filter (where measurement_mode = 'time') <> max(coalesce({c}::varchar, '')) filter (where measurement_mode = 'memory')"
add("records_run_groups", lambda spark, sf: records.run_group_consistency(_reconciled(spark, sf)).select("run_group_id", F.array_join("mismatched_fields", ";").alias("mismatched"), "consistent"),
    f"with {_REC}, g as (select run_group_id, {_differ('W')} as a, {_differ('status')} as b, {_differ('output_length')} as c from r group by 1) select run_group_id, concat_ws(';', case when a then 'W' end, case when b then 'status' end, case when c then 'output_length' end) as mismatched, not (a or b or c) as consistent from g")
add("records_boundaries", lambda spark, sf: records.resource_boundaries(_reconciled(spark, sf)),
    f"with {_REC}, x as (select experiment_id, algorithm, measurement_mode, x_value, bool_and(status = 'OK') as fine, bool_or(status in ('OOM', 'TO', 'MEMORY-CAP-EXCEEDED')) as gone from r group by all) select experiment_id, algorithm, measurement_mode, max(x_value) filter (where fine) as last_successful_x, min(x_value) filter (where gone) as first_resource_failure_x from x group by all")
add("records_preflight", lambda spark, sf: records.preflight(run_records(spark, sf)).groupBy("rule").agg(F.count("*").alias("violations")),
    f"with {_R}, w as (select workload_id from n group by 1 having count(distinct workload_config_sha256) > 1) select 'workload-config' as rule, count(*) as violations from w having count(*) > 0")
add("records_throughput", lambda spark, sf: records.throughput(run_records(spark, sf)), f"with {_R} select {_BASE}, t / QueryTime as samples_per_second from n where status = 'OK' and QueryTime > 0")
add("records_resume", lambda spark, sf: records.not_done(run_records(spark, sf), run_records(spark, sf).where("status = 'OK'")).select("run_group_id", "measurement_mode"), f"with {_R} select run_group_id, measurement_mode from n where status <> 'OK'")


# validation
def _drawn(spark: SparkSession, sf: str) -> tuple:
    j = FIXTURES["part2"](spark, sf)
    return j, samplers.make_sampler("lifted", j, SEED).sample(1000)


def _with_drawn(f):
    return lambda spark, sf: f(*_drawn(spark, sf))


_SAMPLE = f"drawn as ({SQL['sample_part2_lifted']})"
_BUCKET = "('0x' || substr(sha256('pair-bucket|' || r_id || '|' || s_id), 1, 15))::bigint % 128"
add("pair_frequencies_part2", _with_drawn(lambda j, s: validation.frequencies(tiles.overlapping(j), s)), f"with {sides_sql('part2')}, {_SAMPLE}, c as (select r_id, s_id, count(*) as n from drawn group by all) select p.r_id, p.s_id, coalesce(n, 0) as n from p left join c using (r_id, s_id)")
add("bucket_transitions_part2", _with_drawn(lambda j, s: validation.transitions(s)), f"with {_SAMPLE}, b as (select pos, {_BUCKET} as here from drawn), l as (select here, lead(here) over (order by pos) as there from b) select here, there, count(*) as n from l where there is not null group by all")
add(
    "holm_values", lambda spark, sf: validation.holm(read(spark, sf, "part").selectExpr("cast(p_partkey as string) as label", "cast(1e-8 as double) * cast(p_partkey * 37 % 1009 as double) as p")),
    "with v as (select p_partkey::varchar as label, 1e-8::double * (p_partkey * 37 % 1009)::double as p from part), r as (select *, row_number() over (order by p, label) - 1 as k, count(*) over () as m from v) "
    "select label, p, bool_and(p <= 0.01::double / (m - k)) over (order by p, label rows unbounded preceding) as rejected from r",
)
