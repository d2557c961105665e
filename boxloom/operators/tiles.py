"""Pairs of dense joins in tiles: neighbours of each side lie in one array, two arrays meet if their bounds do, and their pairs leave the task as they are met."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import isfinite, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxes import BoxJoin, overlaps, side
from .storage import settled

#: Boxes of an array at most, about; of a cell at least, on average; cells of an axis at most.
CHUNK, LEAST, CELLS = 1 << 13, 64, 1 << 16
#: Pairs that a task compares, about, and tasks at most.
WORK, TASKS = 1 << 24, 1 << 12


def chunks(df: DataFrame, keys: Sequence[str], d: int, prefix: str, rows: int = CHUNK) -> DataFrame:
    """(chunk, keys, boxes, n, lo0, hi0, ..), prefixed: the rows of each key as arrays of about `rows` at most, with their number and bounds. Written once."""
    hot = df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).alias("pieces")).where("pieces > 1")  # at most one for `rows` rows of df
    columns = [c for c in df.columns if c not in keys]
    dealt = df.join(F.broadcast(hot), list(keys), "left").withColumn("piece", F.pmod(F.xxhash64(*columns), F.coalesce("pieces", F.lit(1))))
    bounds = [f(f"{e}{k}").alias(f"{name}{k}") for k in range(d) for name, e, f in (("lo", "l", F.min), ("hi", "u", F.max))]
    made = dealt.groupBy(*keys, "piece").agg(F.collect_list(F.struct(*columns)).alias("boxes"), F.count("*").alias("n"), *bounds).drop("piece")
    return settled(side(made.withColumn("chunk", F.monotonically_increasing_id()), prefix))


def meet(d: int) -> Column:
    """Whether the bounds of two chunks overlap."""
    return reduce(lambda a, b: a & b, [(F.col(f"r_lo{k}") < F.col(f"s_hi{k}")) & (F.col(f"s_lo{k}") < F.col(f"r_hi{k}")) for k in range(d)])


def listed(r: DataFrame, s: DataFrame, met: DataFrame, d: int) -> DataFrame:
    """All columns of both sides for each overlapping pair of the chunks in met(r_chunk, s_chunk, r_n, s_n).

    A chunk of S lies in as many tasks as its tiles are work for, and those of R that it meets go there, box by box. Pairs
    are passed on as they are met; a task holds its boxes of S.
    """
    met = settled(met.select("r_chunk", "s_chunk", (F.col("r_n") * F.col("s_n")).alias("work")))
    total = met.agg(F.coalesce(F.sum("work"), F.lit(0))).first()[0]
    shares = settled(met.groupBy("s_chunk").agg(F.ceil(F.sum("work") / WORK).alias("shares")))
    dealt = met.join(shares, "s_chunk").withColumn("share", F.pmod(F.xxhash64("r_chunk"), F.col("shares"))).select("r_chunk", "s_chunk", "share")
    own = s.select("s_chunk", "s_boxes").join(shares, "s_chunk").select("s_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"), "s_boxes")
    tasks = max(1, min(TASKS, -(-total // WORK)))
    box = lambda df, x: [F.col(f"box.{c}").alias(f"{x}_{c}") for c in df.schema[f"{x}_boxes"].dataType.elementType.names]
    each = lambda df, x: df.repartition(tasks, "s_chunk", "share").select("s_chunk", "share", F.explode(f"{x}_boxes").alias("box")).select("s_chunk", "share", *box(df, x))
    sent = dealt.join(r.select("r_chunk", "r_boxes"), "r_chunk")
    return each(sent, "r").join(each(own, "s").hint("shuffle_hash"), ["s_chunk", "share"]).where(overlaps(d)).drop("s_chunk", "share")


def _axes(j: BoxJoin) -> list[tuple[float, float] | None]:
    """(origin, cell width) of each axis, None for one cell: a few cells for the extents of two boxes, fewer where cells would hold less than LEAST boxes."""
    ends = [f"{e}{k}" for k in range(j.d) for e in "lu"]
    both = j.r.select(F.lit(0).alias("side"), *ends).unionAll(j.s.select(F.lit(1).alias("side"), *ends)).groupBy("side")
    of = lambda k: [F.min(f"l{k}").cast("double").alias(f"lo{k}"), F.max(f"u{k}").cast("double").alias(f"hi{k}"), F.avg(F.col(f"u{k}").cast("double") - F.col(f"l{k}").cast("double")).alias(f"w{k}")]
    rows = both.agg(F.count("*").alias("n"), *[x for k in range(j.d) for x in of(k)]).collect()  # one row for each side
    if len(rows) < 2:
        return [None] * j.d
    origin = [min(x[f"lo{k}"] for x in rows) for k in range(j.d)]
    span = [max(x[f"hi{k}"] for x in rows) - origin[k] for k in range(j.d)]
    width = [sum(x[f"w{k}"] for x in rows) for k in range(j.d)]
    fit = [isfinite(a) and isfinite(b) and isfinite(w) and w > 0 for a, b, w in zip(origin, span, width)]
    cells = [min(CELLS, max(1.0, 6 / j.d * b / w)) if ok else 1.0 for b, w, ok in zip(span, width, fit)]
    fewer = min(1.0, max(1.0, sum(x["n"] for x in rows) / LEAST) / prod(cells)) ** (1 / j.d)
    return [(a, b / max(1.0, x * fewer)) if ok else None for a, b, x, ok in zip(origin, span, cells, fit)]


def _cell(x: Column, axis: tuple[float, float] | None) -> Column:
    """The cell of a coordinate: greater coordinates are never in lesser cells."""
    if axis is None:
        return F.lit(0)
    return F.least(F.lit(float(CELLS)), F.floor((x.cast("double") - F.lit(axis[0])) / F.lit(axis[1]))).cast("int")


def _keyed(df: DataFrame, axes: Sequence[tuple[float, float] | None]) -> tuple[DataFrame, list[str]]:
    """df with the keys that neighbours of about one size share, and their names: a power of two of cell widths, and a cell of each axis."""
    over = [(F.col(f"u{k}").cast("double") - F.col(f"l{k}").cast("double")) / F.lit(a[1]) for k, a in enumerate(axes) if a]
    size = F.least(F.lit(40), F.ceil(F.log2(F.greatest(F.lit(1.0), F.lit(1.0), *over))).cast("int"))
    return df.select("*", size.alias("size"), *[_cell(F.col(f"l{k}"), a).alias(f"c{k}") for k, a in enumerate(axes)]), ["size", *[f"c{k}" for k in range(len(axes))]]


def overlapping(join: BoxJoin, rows: int = CHUNK) -> DataFrame:
    """All columns of both sides for each overlapping pair, each once: chunks are boxes of about one size that begin in one cell.

    Chunks (without their boxes) are listed in the cells of the first axis that their bounds cover, and two meet in that
    of the greater lower bound.
    """
    j = join.clean()
    axes = _axes(j)
    r, s = (chunks(*_keyed(df, axes), j.d, prefix, rows) for df, prefix in ((j.r, "r_"), (j.s, "s_")))
    covers = lambda df, x: df.drop(f"{x}boxes").withColumn("at", F.explode(F.sequence(F.col(f"{x}c0"), _cell(F.col(f"{x}hi0"), axes[0]))))
    met = covers(r, "r_").join(covers(s, "s_"), "at").where((F.col("at") == F.greatest("r_c0", "s_c0")) & meet(j.d))
    return listed(r, s, met, j.d)


def in_strips(of: DataFrame, join: BoxJoin, rows: int = CHUNK) -> DataFrame:
    """overlapping() by strips `of` the first axis, as sweep.strips() has them: a strip's starts meet each other and what was carried into it."""
    axes = [None, *_axes(join.clean())[1:]]
    sides = []
    for number, prefix in ((0, "r_"), (1, "s_")):
        own, keys = _keyed(of.where(F.col("side") == number).drop("side"), axes)
        sides.append(chunks(own, ["strip", "carried", *keys], join.d, prefix, rows))
    r, s = sides
    met = r.drop("r_boxes").join(s.drop("s_boxes"), F.col("r_strip") == F.col("s_strip")).where(~(F.col("r_carried") & F.col("s_carried")) & meet(join.d))
    return listed(r, s, met, join.d)
