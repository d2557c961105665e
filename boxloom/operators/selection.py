"""Points of ranges by their place in an order, for many ranges at a time, without a list of what is in them.

Points are cut into blocks of the order. A task counts the points of a block in each range, so a place falls to a block, and
another finds it there by halving the block.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import uniform_below
from .dominance import _before, _met
from .storage import settled

#: Points of a block at most, blocks where they are smaller, and the ranges or draws that meet a block in one task.
POINTS, BLOCKS, CHUNK = 1 << 20, 16, 1 << 18


def counts_inside(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each column of lo and hi(axis, range) the columns of p(axis, point) with lo <= p < hi on all axes."""
    d, m, k = len(p), p.shape[1], lo.shape[1]
    if not m or not k:
        return np.zeros(k, np.int64)
    if d == 1:
        x = np.sort(p[0])
        return np.searchsorted(x, hi[0]) - np.searchsorted(x, lo[0])
    point = np.arange(m + (4 * k if d == 2 else k)) < m

    def places(x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        out[np.lexsort((point, x))] = np.arange(len(x))  # ends stand before equal points
        return out

    if d == 2:  # what is below the four corners
        first, second = (places(np.concatenate([p[j], *ends])) for j, ends in ((0, (hi[0], lo[0], hi[0], lo[0])), (1, (hi[1], hi[1], lo[1], lo[1]))))
        n = _before(first, second, point)[m:].reshape(4, k)
        return n[0] - n[1] - n[2] + n[3]
    halves = []
    for j in range(d):
        halves += [places(np.concatenate([p[j], hi[j]])), m + k - 1 - places(np.concatenate([p[j], lo[j]]))]
    all_ = np.stack(halves).astype(np.int32)
    return _met(all_[:, :m], all_[:, m:])


def kth_inside(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each range the column of p that is the k-th, from 0, of those in it; k is below their number."""
    m, k = p.shape[1], k.copy()
    first = np.sort(p[0])
    own, lo0, hi0 = (np.searchsorted(first, x) for x in (p[0], lo[0], hi[0]))  # 0 .. m, so that a node and a place are one number
    place, at = np.arange(m), np.zeros(len(k), np.int64)
    for h in reversed(range(max(m - 1, 0).bit_length())):
        left = place >> h & 1 == 0  # a range looks at the left half of its node alone
        key = lambda node, x: node * (m + 1) + x
        n = counts_inside(np.vstack([key(place >> h, own), p[1:]])[:, left], np.vstack([key(at >> h, lo0), lo[1:]]), np.vstack([key(at >> h, hi0), hi[1:]]))
        right = k >= n
        k[right] -= n[right]
        at[right] += 1 << h
    return at


def _numbers(t: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([t.column(c).to_numpy() for c in names])


def _count(points: pa.Table, ranges: pa.Table, d: int) -> pa.Table:
    axes = [[f"{e}{j}" for j in range(d)] for e in "rlu"]
    n = counts_inside(_numbers(points, axes[0]), _numbers(ranges, axes[1]), _numbers(ranges, axes[2]))
    return pa.table({"qid": ranges.column("qid"), "block": ranges.column("block"), "n": pa.array(n)}).filter(pa.array(n > 0))


def _find(points: pa.Table, drawn: pa.Table, d: int) -> pa.Table:
    axes = [[f"{e}{j}" for j in range(d)] for e in "rlu"]
    points = points.sort_by("at")
    at = kth_inside(_numbers(points, axes[0]), _numbers(drawn, axes[1]), _numbers(drawn, axes[2]), drawn.column("k").to_numpy())
    return pa.table({"qid": drawn.column("qid"), "pos": drawn.column("pos"), "id": points.column("id").take(pa.array(at))})


def _meeting(points: DataFrame, asked: DataFrame, chunk: int, step: functools.partial, schema: str) -> DataFrame:
    """Each block's points with what asks for them, in chunks of about as many rows of it as `chunk`."""
    hot = asked.groupBy("block").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    dealt = asked.join(F.broadcast(hot), "block").withColumn("chunk", F.pmod(F.xxhash64("qid", *(["pos"] if "pos" in asked.columns else [])), F.col("chunks")).cast("int")).drop("chunks")
    listed = points.join(F.broadcast(hot), "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return listed.groupBy("block", "chunk").cogroup(dealt.groupBy("block", "chunk")).applyInArrow(lambda p, q: step(p, q), schema)


def drawn(points: DataFrame, ranges: DataFrame, d: int, t: int, seed: str, axis: int | None = None, block: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(qid, pos, id): t independent uniform points with replacement of each of ranges(qid, l0, u0, ..) with points(id, at, r0, ..) in it.

    Coordinates are places, `at` the one in the order that numbers a range's points. Where that is the order of an axis, a
    range meets the blocks between its ends alone, else all blocks, which are BLOCKS up to BLOCKS * POINTS points.
    """
    n = points.count()
    block = block or min(POINTS, max(1, -(-n // BLOCKS)))
    kinds = {c: t for df in (points, ranges) for c, t in df.dtypes}
    p, ranges = settled(points.withColumn("block", F.expr(f"at div {block}"))), settled(ranges)
    ends = (F.lit(0), F.lit((n - 1) // block)) if axis is None else (F.expr(f"l{axis} div {block}"), F.expr(f"(u{axis} - 1) div {block}"))
    asked = ranges.withColumn("block", F.explode(F.sequence(*[e.cast("bigint") for e in ends])))
    parts = settled(_meeting(p, asked, chunk, functools.partial(_count, d=d), f"qid {kinds['qid']}, block bigint, n bigint"))
    order = Window.partitionBy("qid").orderBy("block")
    parts = parts.withColumn("from", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    whole = parts.groupBy("qid").agg(F.sum("n").cast("bigint").alias("all"))
    places = whole.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(t - 1)))).withColumn("place", uniform_below(seed, F.concat_ws(":", "qid", "pos"), F.col("all")))
    places = settled(places.drop("all"))  # a draw is many hashes, made once
    met = places.join(parts, "qid").where((F.col("place") >= F.col("from")) & (F.col("place") < F.col("from") + F.col("n")))
    met = settled(met.select("qid", "pos", "block", (F.col("place") - F.col("from")).alias("k")).join(ranges, "qid"))
    return _meeting(p, met, chunk, functools.partial(_find, d=d), f"qid {kinds['qid']}, pos int, id {kinds['id']}")
