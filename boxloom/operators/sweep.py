"""The plane sweep: start and end events in order, pairs owned by the later start, weights of start events."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .boxes import BoxJoin, nonempty
from .dominance import open_at, overlap, weighed
from .prefix import running
from .storage import settled
from .tiles import in_strips

#: Starts of a strip, starts that meet the open boxes together, and open boxes that they meet at a time.
STRIP, STARTS, OPEN = 1 << 17, 256, 1 << 14


def events(join: BoxJoin) -> DataFrame:
    """(coord, is_end, side, id) of both sides on axis 0: in sweep order ends come first, then R before S, then ids."""
    def of(df: DataFrame, side: int) -> DataFrame:
        df = df.where(nonempty(join.d))
        return df.select(F.col("l0").alias("coord"), F.lit(0).alias("is_end"), F.lit(side).alias("side"), "id").unionAll(df.select(F.col("u0"), F.lit(1), F.lit(side), "id"))

    return of(join.r, 0).unionAll(of(join.s, 1))


def order() -> list:
    return ["coord", F.col("is_end").desc(), "side", "id"]


def swept(join: BoxJoin) -> DataFrame:
    """Events with their place in the order, the ordinal of starts, and how many boxes of each side are open before them."""
    open_ = lambda side: F.when(F.col("side") == side, 1 - 2 * F.col("is_end")).otherwise(0).cast("bigint")
    sums = {"place": F.lit(1).cast("bigint"), "starts_before": (1 - F.col("is_end")).cast("bigint"), "active_r": open_(0), "active_s": open_(1)}
    return running(events(join), order(), sums)


def owner_side() -> Column:
    """The side whose start comes later on axis 0 and owns the pair; equal starts belong to S."""
    return F.when(F.col("r_l0") > F.col("s_l0"), 0).otherwise(1)


def weights(join: BoxJoin) -> DataFrame:
    """(side, id, weight) of start events that own a pair; weights add up to W. No pair is formed: on one axis the weight is what is open, on more those open that meet on the others are counted."""
    if join.d == 1:
        e = swept(join).where("is_end = 0").select("side", "id", F.when(F.col("side") == 0, F.col("active_s")).otherwise(F.col("active_r")).alias("weight"))
        return e.where("weight > 0")
    j = join.clean()
    rest = [overlap(k) for k in range(1, j.d)]
    # a box owns those of the other side that are open where it starts; R's start precedes S's at equal coordinates
    owned = [weighed(j.s, j.r, [open_at(0, False), *rest]), weighed(j.r, j.s, [open_at(0, True), *rest])]
    return owned[0].select(F.lit(0).alias("side"), "id", "weight").unionAll(owned[1].select(F.lit(1).alias("side"), "id", "weight"))


def strips(join: BoxJoin, starts: int = STRIP) -> DataFrame:
    """(strip, carried, side, id, l0.., u0..): strips of axis 0 with about `starts` starts each, and in each the boxes that are open in it.

    A box is in the strip of its start and, carried over the left border, in each later one that begins before its end. The
    borders are quantiles of the starts, one for each strip, found in one pass; a coordinate at which very many boxes start
    stays in one strip.
    """
    j = join.clean()
    ends = [f"{e}{k}" for e in "lu" for k in range(j.d)]
    both = settled(j.r.select(F.lit(0).alias("side"), "id", *ends).unionAll(j.s.select(F.lit(1).alias("side"), "id", *ends)))
    many = max(1, -(-both.count() // starts))
    found = both.agg(F.percentile_approx("l0", [i / many for i in range(1, many)], 20 * many)).first()[0] if many > 1 else []
    borders = np.array(sorted(set(found or [])), np.int64 if dict(both.dtypes)["l0"] == "bigint" else np.float64)
    numbered = both.mapInArrow(functools.partial(_numbered, borders=borders), StructType([*both.schema]).add("first", IntegerType()).add("last", IntegerType()))
    each = numbered.withColumn("strip", F.explode(F.sequence("first", "last")))
    return each.withColumn("carried", F.col("strip") > F.col("first")).select("strip", "carried", "side", "id", *ends)


def _numbered(batches: Iterator[pa.RecordBatch], borders: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds to each box the strip of its start and the last that begins before its end, by halving."""
    for b in batches:
        first, last = np.searchsorted(borders, b.column("l0").to_numpy(), "right"), np.searchsorted(borders, b.column("u0").to_numpy(), "left")
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first, pa.int32()), pa.array(last, pa.int32())], [*b.schema.names, "first", "last"])


def _pass(t: pa.Table, d: int, listed: bool) -> Iterator[pa.Table]:
    """A strip in order of its starts: each block of them meets what is open then, and no box that has ended is looked at again.

    A pair belongs to the later start, S's at equal ones, so it is met in one strip only. Pairs are passed on as they are
    met: at most STARTS * OPEN are held, however many a strip has.
    """
    side, carried = t.column("side").to_numpy(), t.column("carried").to_numpy()
    low, high = (np.stack([t.column(f"{e}{k}").to_numpy() for k in range(d)]) for e in "lu")
    order = np.lexsort((low[-1], side, low[0], ~carried))  # what is carried is open from the beginning; many equal starts are neighbours on the last axis
    first = int(carried.sum())
    open_, starts = order[:first], order[first:]
    ids = t.column("id").combine_chunks()
    for at in range(0, len(starts), STARTS):
        now = starts[at : at + STARTS]
        open_ = open_[high[0, open_] > low[0, now[0]]]
        open_, n = np.concatenate([open_, now]), np.zeros(len(now), np.int64)
        met = open_
        for k in range(1, d):
            met = met[(low[k, met] < high[k, now].max()) & (high[k, met] > low[k, now].min())]
        for begin in range(0, len(met), OPEN):
            some = met[begin : begin + OPEN]
            a, b = now[:, None], some[None, :]
            before = (low[0, b] < low[0, a]) | ((low[0, b] == low[0, a]) & (side[b] < side[a]))
            mask = (side[a] != side[b]) & before & (high[0, b] > low[0, a])
            for k in range(1, d):
                mask &= (low[k, b] < high[k, a]) & (low[k, a] < high[k, b])
            n += mask.sum(axis=1)
            if listed and mask.any():
                i, k = np.nonzero(mask)
                own, with_ = now[i], some[k]
                r, s = np.where(side[own] == 0, own, with_), np.where(side[own] == 0, with_, own)
                yield pa.table({"r_id": ids.take(pa.array(r)), "s_id": ids.take(pa.array(s))})
        if not listed and n.any():
            own = now[n > 0]
            yield pa.table({"side": pa.array(side[own], pa.int32()), "id": ids.take(pa.array(own)), "weight": pa.array(n[n > 0], pa.int64())})


def _passes(d: int, listed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in _pass(pa.Table.from_batches(list(batches)), d, listed):
            yield from made.to_batches()

    return one


def strip_pairs(join: BoxJoin, starts: int = STRIP) -> DataFrame:
    """(r_id, s_id) of each overlapping pair, each once, in the strip of its later start: what starts there meets what was carried in and what else starts there."""
    return in_strips(strips(join, starts), join).select("r_id", "s_id")


def strip_weights(join: BoxJoin, starts: int = STRIP) -> DataFrame:
    """weights() by strips, for three axes or more: the pairs of each start event are counted where it stands, none is passed on.

    On one axis or two, what a strip would carry over its border is a number (weights()), as carried boxes grow with the square of the input.
    """
    if join.d <= 2:
        return weights(join).select("side", "id", "weight")
    of = strips(join, starts)
    schema = StructType().add("side", IntegerType()).add("id", of.schema["id"].dataType).add("weight", LongType())
    return of.groupBy("strip").applyInArrow(_passes(join.d, False), schema)
