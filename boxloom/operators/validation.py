"""Statistical checks of samples: pair frequencies, transitions of hashed buckets, their tests, and Holm's correction."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import bits60
from .boxes import BoxJoin
from .joins import grid_pairs, invalid_pairs, pairs
from .prefix import ROWS, ranked, running
from .storage import settled

#: Join sizes for which the report is made, and buckets of the transition test.
LEAST, MOST, BUCKETS = 2, 2000, 128


def frequencies(joined: DataFrame, sample: DataFrame) -> DataFrame:
    """(r_id, s_id, n) for every pair of the join, also those never drawn. Of a sample of up to ROWS different pairs, they go to the tasks that make the join, so no pair of the join is shuffled."""
    n = settled(sample.groupBy("r_id", "s_id").agg(F.count("*").cast("bigint").alias("n")))
    n = F.broadcast(n) if n.count() <= ROWS else n
    return joined.select("r_id", "s_id").join(n, ["r_id", "s_id"], "left").select("r_id", "s_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def chi_square(freq: DataFrame) -> DataFrame:
    """Samples, pairs and Pearson's statistic against equal frequencies, from exact sums of counts and squares."""
    s = freq.agg(F.count("*").alias("w"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return s.select("w", "t", (F.col("squares") * F.col("w") / F.col("t") - F.col("t")).alias("statistic"))


def bucketed(sample: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return sample.select("pos", (bits60(F.lit("pair-bucket"), F.col("r_id"), F.col("s_id")) % buckets).alias("bucket"))


def transitions(sample: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(here, there, n): buckets of samples that follow each other; each sample is joined to the one before it by position."""
    b = bucketed(sample, buckets)
    after = b.select((F.col("pos") - 1).alias("pos"), F.col("bucket").alias("there"))
    return b.withColumnRenamed("bucket", "here").join(after, "pos").groupBy("here", "there").agg(F.count("*").cast("bigint").alias("n"))


def chi_square_tail(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom >= x): series or continued fraction of the incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def uniformity(joined: DataFrame, sample: DataFrame) -> DataFrame:
    """One row (draws, pairs, chi2_pairs, p_pairs): equal frequencies of all pairs of the join."""
    p = F.udf(lambda x, k: None if x is None else chi_square_tail(x, k - 1), "double")  # one row
    return chi_square(frequencies(joined, sample)).select(F.col("t").alias("draws"), F.col("w").alias("pairs"), F.col("statistic").alias("chi2_pairs"), p("statistic", "w").alias("p_pairs"))


def independence(sample: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row (chi2_steps, p_steps, correlation) for buckets of successive samples, all null where one side has a single bucket."""
    n = settled(transitions(sample, buckets))  # buckets^2 rows at most
    margin = lambda c: n.groupBy(c).agg(F.sum("n").alias(f"of_{c}"))
    both = n.join(margin("here"), "here").join(margin("there"), "there")
    kinds = lambda c: F.countDistinct(c)
    mean = lambda x: F.sum(F.col("n") * x) / F.sum("n")
    x, y = F.col("here"), F.col("there")
    row = both.agg(
        (F.sum("n") * (F.sum(F.col("n") * F.col("n") / (F.col("of_here") * F.col("of_there"))) - 1)).alias("chi2"), ((kinds("here") - 1) * (kinds("there") - 1)).alias("k"),
        (mean(x * y) - mean(x) * mean(y)).alias("xy"), (mean(x * x) - mean(x) * mean(x)).alias("xx"), (mean(y * y) - mean(y) * mean(y)).alias("yy"),
    )
    p = F.udf(lambda x, k: chi_square_tail(x, k) if x is not None and k else None, "double")  # one row
    fine = F.col("k") > 0
    return row.select(F.when(fine, F.col("chi2")).alias("chi2_steps"), p("chi2", "k").alias("p_steps"), F.when(fine, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("correlation"))


def distribution_report(join: BoxJoin, sample: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row of uniformity() and independence(), for a sample of a join of LEAST to MOST pairs; a sample that is no pair of it is an error."""
    if buckets < 2:
        raise ValueError("at least two buckets are needed")
    joined = settled(pairs(grid_pairs(join)).limit(MOST + 1))
    sample = settled(sample)
    w = joined.count()
    if not LEAST <= w <= MOST:
        raise ValueError(f"the report needs {LEAST} to {MOST} pairs")
    if not invalid_pairs(join, sample).isEmpty():
        raise AssertionError("a sample is no pair of the join")
    return uniformity(joined, sample).crossJoin(independence(sample, buckets))


def gate(reports: DataFrame, level: float = 0.01) -> DataFrame:
    """(workload, kind, status): FAIL where Holm's correction rejects one of a report's tests, all p-values being one family; else PASS.

    reports(workload, kind, p_pairs, p_steps) are rows of distribution_report; a test that couldn't be made is null and counts for nothing.
    """
    label = lambda test: F.concat_ws("|", "workload", "kind", F.lit(test))
    each = reports.select("workload", "kind", F.explode(F.array(*[F.struct(label(t).alias("label"), F.col(c).alias("p")) for t, c in (("pairs", "p_pairs"), ("steps", "p_steps"))])).alias("e")).select("workload", "kind", "e.*")
    tested = holm(each.where("p is not null").select("label", "p"), level).select("label", "rejected")
    found = each.join(tested, "label", "left").groupBy("workload", "kind").agg(F.coalesce(F.bool_or("rejected"), F.lit(False)).alias("bad"))
    return found.select("workload", "kind", F.when(F.col("bad"), "FAIL").otherwise("PASS").alias("status"))


def holm(pvalues: DataFrame, level: float = 0.01) -> DataFrame:
    """Adds `rejected` to pvalues(label, p): step-down in order of (p, label) while p <= level / (m - rank)."""
    m = pvalues.count()
    fine = F.col("p") <= F.lit(level) / (F.lit(m) - F.col("_rank"))
    placed = ranked(pvalues, ["p", "label"], "_rank").withColumn("_failed", F.when(fine, 0).otherwise(1))
    return running(placed, ["p", "label"], {"_failures": F.col("_failed")}, before=False).withColumn("rejected", F.col("_failures") == 0).drop("_rank", "_failed", "_failures")
