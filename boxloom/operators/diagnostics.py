"""Diagnostics of a relation's geometry: quantiles of shape, fractions of repeated endpoints and of boxes at the boundary."""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boxes import dimension


def shape_quantiles(df: DataFrame, at: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Exact interpolated quantiles of relative lengths per axis, of volume, its logarithm and the aspect ratio; lengths are relative to the extent of all boxes."""
    d = dimension(df)
    span = df.agg(*[(F.max(f"u{j}") - F.min(f"l{j}")).cast("double").alias(f"w{j}") for j in range(d)])
    rel = [((F.col(f"u{j}") - F.col(f"l{j}")).cast("double") / F.col(f"w{j}")).alias(f"length{j}") for j in range(d)]
    rows = df.join(F.broadcast(span)).select(*rel)  # one row of extents
    lengths = [F.col(f"length{j}") for j in range(d)]
    rows = rows.withColumn("volume", reduce(lambda a, b: a * b, lengths)).withColumn("log_volume", F.ln("volume"))
    rows = rows.withColumn("aspect", (F.greatest(*lengths) / F.least(*lengths)) if d > 1 else F.lit(1.0))
    q = f"array({', '.join(map(str, at))})"
    return reduce(DataFrame.unionAll, [rows.agg(F.expr(f"percentile({c}, {q})").alias("q")).select(F.lit(c).alias("measure"), *[F.col("q")[i].alias(f"p{round(100 * a)}") for i, a in enumerate(at)]) for c in rows.columns])


def duplicate_endpoints(df: DataFrame) -> DataFrame:
    """(axis, fraction): 1 - distinct / all over the lower and upper endpoints of each axis."""
    d = dimension(df)
    ends = F.explode(F.flatten(F.array(*[F.array(F.struct(F.lit(j).alias("axis"), F.col(f"l{j}").alias("v")), F.struct(F.lit(j).alias("axis"), F.col(f"u{j}").alias("v"))) for j in range(d)])))
    n = df.select(ends.alias("e")).select("e.*").groupBy("axis", "v").agg(F.count("*").alias("n"))
    return n.groupBy("axis").agg((1 - F.count("*") / F.sum("n")).alias("fraction"))


def boundary_fraction(df: DataFrame) -> DataFrame:
    """(axis, fraction): boxes that reach the least or the greatest endpoint of the axis."""
    d = dimension(df)
    ends = df.agg(*[f(c).alias(f"_{c}") for j in range(d) for f, c in ((F.min, f"l{j}"), (F.max, f"u{j}"))])
    at = df.join(F.broadcast(ends))  # one row of extremes
    return reduce(DataFrame.unionAll, [at.agg((F.sum(F.when((F.col(f"l{j}") == F.col(f"_l{j}")) | (F.col(f"u{j}") == F.col(f"_u{j}")), 1).otherwise(0)) / F.count("*")).alias("fraction")).select(F.lit(j).alias("axis"), "fraction") for j in range(d)])


def exact_sum(df: DataFrame, column: str) -> int:
    """The exact sum of doubles as an integer number of 2^-1074: mantissas add up by exponent, then big integers on the driver (2,046 rows at most)."""
    @F.pandas_udf("struct<e:int,hi:bigint,lo:bigint>")
    def parts(x: pd.Series) -> pd.DataFrame:
        m, e = np.frexp(x.to_numpy(float))
        m = (m * 2.0**53).astype(np.int64)
        e = e.astype(np.int64) - 53
        low = np.maximum(0, -1074 - e)
        return pd.DataFrame({"e": (e + low).astype(np.int32), "hi": (m >> low) >> 26, "lo": (m >> low) & ((1 << 26) - 1)})

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = df.select(parts(F.col(column)).alias("p")).groupBy("p.e").agg(wide("p.hi").alias("hi"), wide("p.lo").alias("lo")).collect()
    return sum(((int(r["hi"]) << 26) + int(r["lo"])) << (r["e"] + 1074) for r in rows)
