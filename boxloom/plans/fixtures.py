"""Box relations over the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.boxes import BoxJoin, around, boxes


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(r: str, s: str):
    def made(spark: SparkSession, sf_dir: str) -> BoxJoin:
        o = read(spark, sf_dir, "orders").withColumn("day", F.datediff("o_orderdate", F.lit("1970-01-01")).cast("bigint"))
        span = lambda df, days: boxes(df, "o_orderkey", ["day"], [F.col("day") + F.lit(days).cast("bigint")])
        return BoxJoin(span(o.where(r), 30), span(o.where(s), 7))

    return made


#: Conditions of the two sides; both fixtures split the whole table.
ORDERS = {"ord1": ("o_orderkey % 5 = 0", "o_orderkey % 5 <> 0"), "ord_all": ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1")}


def part2(spark: SparkSession, sf_dir: str) -> BoxJoin:
    p = read(spark, sf_dir, "part").withColumn("x", F.col("p_size").cast("double")).withColumn("y", F.col("p_retailprice").cast("double"))
    box = lambda df, w, h: boxes(df, "p_partkey", ["x", "y"], [F.col("x") + float(w), F.col("y") + float(h)])
    return BoxJoin(box(p.where("p_partkey % 2 = 0"), 5, 2), box(p.where("p_partkey % 2 = 1"), 1, 1))


def _events(level: tuple[int, int]):
    def made(spark: SparkSession, sf_dir: str) -> BoxJoin:
        e = read(spark, sf_dir, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.floor(F.col("value") * 100).cast("bigint").alias("c"))
        return BoxJoin(around(e.where("user_id % 2 = 0"), "event_id", ["t", "c"], level), around(e.where("user_id % 2 = 1"), "event_id", ["t", "c"], level))

    return made


def _embedded(d: int):
    def made(spark: SparkSession, sf_dir: str) -> BoxJoin:
        e = read(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[j].cast("double").alias(f"e{j}") for j in range(d)])
        box = lambda df: boxes(df, "vec_id", [F.col(f"e{j}") - 0.05 for j in range(d)], [F.col(f"e{j}") + 0.05 for j in range(d)])
        return BoxJoin(box(e.where("vec_id % 2 = 0")), box(e.where("vec_id % 2 = 1")))

    return made


EVENT_LEVELS = {"evt2_l1": (3_600_000, 500), "evt2_l2": (21_600_000, 1000)}
FIXTURES = {k: _orders(*v) for k, v in ORDERS.items()} | {"part2": part2} | {k: _events(v) for k, v in EVENT_LEVELS.items()} | {f"emb{d}": _embedded(d) for d in (1, 2, 3, 4)}
DIMENSION = {"ord1": 1, "ord_all": 1, "part2": 2, "evt2_l1": 2, "evt2_l2": 2, "emb1": 1, "emb2": 2, "emb3": 3, "emb4": 4}


def _sql_sides() -> dict[str, tuple[str, str]]:
    day = "date_diff('day', date '1970-01-01', o_orderdate::date)::bigint"
    out = {
        **{k: tuple(f"select o_orderkey as id, {day} as l0, {day} + {n} as u0 from orders where {c}" for n, c in zip((30, 7), v)) for k, v in ORDERS.items()},
        "part2": tuple(
            f"select p_partkey as id, p_size::double as l0, p_retailprice::double as l1, p_size::double + {w} as u0, p_retailprice::double + {h} as u1 from part where p_partkey % 2 = {m}"
            for w, h, m in ((5, 2, 0), (1, 1, 1))
        ),
    }
    for name, (rt, rc) in EVENT_LEVELS.items():
        t, c = "epoch_us(ts) // 1000", "floor(value * 100)::bigint"
        out[name] = tuple(f"select event_id as id, {t} - {rt} as l0, {c} - {rc} as l1, {t} + {rt + 1} as u0, {c} + {rc + 1} as u1 from events where user_id % 2 = {m}" for m in (0, 1))
    for d in (1, 2, 3, 4):
        e = lambda j: f"embedding[{j + 1}]::double"
        cols = ", ".join([*(f"{e(j)} - 0.05 as l{j}" for j in range(d)), *(f"{e(j)} + 0.05 as u{j}" for j in range(d))])
        out[f"emb{d}"] = tuple(f"select vec_id as id, {cols} from embeddings where vec_id % 2 = {m}" for m in (0, 1))
    return out


SIDES = _sql_sides()


def overlap_sql(d: int, first: int = 0) -> str:
    return " and ".join(f"r.l{j} < s.u{j} and s.l{j} < r.u{j}" for j in range(first, d)) or "true"


def sides_sql(fixture: str) -> str:
    """CTEs r and s, and p: their overlapping pairs by the plain predicate, with all columns."""
    r, s = SIDES[fixture]
    d = DIMENSION[fixture]
    cols = ", ".join(f"{x}.{e}{j} as {x}_{e}{j}" for x in "rs" for e in "lu" for j in range(d))
    return f"r as ({r}), s as ({s}), p as (select r.id as r_id, s.id as s_id, {cols} from r join s on {overlap_sql(d)})"
