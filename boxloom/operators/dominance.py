"""Counts of the points that meet queries, without a pair. On one axis or two by the points below corners: ranges of each axis, a table of
the ranges, a sorted pass in each. On three axes and more by tiles: chunks of points against chunks of queries, bounds before rows."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import ROWS, counts_at, in_ranges
from .storage import settled

#: Points, and queries, of a tile; of each block in a tile.
CHUNK, BLOCK = 1 << 15, 64
#: One axis of a term: the points' column, the queries' column, whether equal values count, and the sign of the count.
Half = tuple[str, str, bool, int]


def overlap(j: int) -> list[Half]:
    """Strict overlap on axis j: points that begin before the query ends, less those that end up to where it begins."""
    return [(f"l{j}", f"u{j}", False, 1), (f"u{j}", f"l{j}", True, -1)]


def open_at(j: int, inclusive: bool) -> list[Half]:
    """Points that begin before the query does (or with it, where `inclusive`) and end after that."""
    return [(f"l{j}", f"l{j}", inclusive, 1), (f"u{j}", f"l{j}", True, -1)]


def begun_in(j: int, inclusive: bool) -> list[Half]:
    """Points that begin within the query: after its lower end (or at it, where `inclusive`) and before its upper end."""
    return [(f"l{j}", f"u{j}", False, 1), (f"l{j}", f"l{j}", not inclusive, -1)]


def _before(first: np.ndarray, second: np.ndarray, point: np.ndarray) -> np.ndarray:
    """For each row the points before it in two orders, given by its places in both: halves of the first order, in the second's order at each level."""
    n = len(first)
    out = np.zeros(n, np.int64)
    place = np.empty(n, np.int64)
    place[second] = first
    is_point = np.empty(n, bool)
    is_point[second] = point
    i = np.arange(n)
    for h in reversed(range(max(n - 1, 0).bit_length())):
        high = (place >> h) & 1 == 1
        start = place >> (h + 1) << (h + 1)  # places are 0 .. n - 1, so a block of them lies at its own places
        points = np.append(0, np.cumsum(is_point & ~high))
        out[place[high]] += points[1:][high] - points[start[high]]
        lows = np.append(0, np.cumsum(~high))
        before = lows[:-1] - lows[start]
        to = start + np.where(high, (1 << h) + i - start - before, before)
        place[to], is_point[to] = place.copy(), is_point.copy()
    return out[first]


def _counted(batches: Iterator[pa.RecordBatch], first: Sequence[str], second: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Adds to n of each query the points of its term before it by both orders, among the rows of its range."""
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    term, point, n = (t.column(c).to_numpy() for c in ("term", "point", "n"))
    n = n.copy()

    def places(columns: Sequence[str], rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        out[np.lexsort([t.column(c).to_numpy()[rows] for c in reversed(columns)])] = np.arange(len(rows))
        return out

    for k in np.unique(term):
        rows = np.flatnonzero(term == k)
        n[rows] += _before(places(first, rows), places(second, rows), point[rows] == 1)
    yield from t.set_column(t.schema.get_field_index("n"), "n", pa.array(n)).to_batches()


def term_counts(points: DataFrame, queries: DataFrame, terms: Sequence[Sequence[Half]], rows: int = ROWS) -> DataFrame:
    """(term, id, n): for each of queries(id, ..) and each term, the points whose columns are below the query's on all of the term's axes (one or two).

    With two axes, rows are dealt into ranges of about `rows` of the whole order of one axis, then of the other. A point
    below a query lies in its range of the first axis, or in an earlier one and in its range of the second, or in earlier
    ones of both: the first two are counted where the rows lie, the last in a table with a row for two ranges. So each row
    is moved twice, however many points are below it, and equal coordinates are no hot range.
    """
    if len(terms[0]) == 1:
        found = [counts_at(points.select(F.col(p).alias("x")), queries.select("id", F.col(q).alias("x"), F.lit(inclusive).alias("inclusive"))).select(F.lit(k).alias("term"), "id", F.col("n_below").alias("n")) for k, ((p, q, inclusive, _),) in enumerate(terms)]
        return functools.reduce(DataFrame.unionAll, found)

    def listed(df: DataFrame, point: int) -> DataFrame:
        """A row for each term: queries stand before equal points, or after them where they count them."""
        tie = lambda half: F.lit(1 if point else 2 if half[2] else 0)
        of = lambda half: F.col(half[0] if point else half[1])
        each = [F.struct(F.lit(k).alias("term"), of(a).alias("x"), tie(a).alias("x_tie"), of(b).alias("y"), tie(b).alias("y_tie")) for k, (a, b) in enumerate(terms)]
        return df.withColumn("e", F.explode(F.array(*each))).select(F.lit(point).alias("point"), "id", "e.*", F.lit(0).cast("bigint").alias("n"))

    many = len(terms) * (points.count() + queries.count())
    both = listed(points, 1).unionAll(listed(queries, 0))  # points keep their ids, so that many equal ones are dealt apart
    ranges = max(1, -(-many // rows))
    by = lambda df, *orders: df.mapInArrow(functools.partial(_counted, first=orders[0], second=orders[1]), df.schema)
    if ranges == 1:
        return by(both.coalesce(1), ("x", "x_tie"), ("y", "y_tie")).where("point = 0").select("term", "id", "n")
    one = by(in_ranges(both, ["x", "x_tie"], ranges), ("x", "x_tie"), ("y", "y_tie")).select("point", "id", "term", "y", "y_tie", "n", F.col("range_no").alias("i"))
    two = settled(by(in_ranges(one, ["y", "y_tie"], ranges), ("i", "point"), ("y", "y_tie")).select("point", "term", "id", "n", "i", F.col("range_no").alias("j")))
    grid = points.sparkSession.range(len(terms) * ranges * ranges).selectExpr(f"cast(id div {ranges * ranges} as int) as term", f"cast(id div {ranges} % {ranges} as int) as i", f"cast(id % {ranges} as int) as j", "0L as c")
    cells = grid.unionAll(two.where("point = 1").groupBy("term", "i", "j").agg(F.count("*").alias("c"))).groupBy("term", "i", "j").agg(F.sum("c").alias("c"))
    cells = cells.withColumn("c", F.expr("coalesce(sum(c) over (partition by term, i order by j rows between unbounded preceding and 1 preceding), 0)"))
    cells = cells.withColumn("c", F.expr("coalesce(sum(c) over (partition by term, j order by i rows between unbounded preceding and 1 preceding), 0)"))
    return two.where("point = 0").join(F.broadcast(cells), ["term", "i", "j"]).select("term", "id", (F.col("n") + F.col("c")).alias("n"))


def weighed(points: DataFrame, queries: DataFrame, axes: Sequence[Sequence[Half]], rows: int = ROWS, chunk: int | None = None) -> DataFrame:
    """(id, weight): for each query the points that meet it on all axes, where there are any; an axis is a signed sum of halves that is 0 or 1."""
    if len(axes) > 2:
        return _tiled(points, queries, axes, chunk or CHUNK)
    terms = list(itertools.product(*axes))
    signs = F.array(*[F.lit(int(np.prod([half[3] for half in t]))).cast("bigint") for t in terms])
    counted = term_counts(points, queries, terms, rows)
    return counted.groupBy("id").agg(F.sum(F.get(signs, F.col("term")) * F.col("n")).alias("weight")).where("weight > 0")


def _curve(places: np.ndarray) -> np.ndarray:
    """An order of the columns of places(axis, row) in which neighbours are near on all axes: leading bits of the places, interleaved."""
    d, n = places.shape
    bits = max(1, min(10, 60 // d))
    at = [(np.argsort(np.argsort(p, kind="stable"), kind="stable") << bits) // max(n, 1) for p in places]
    code = np.zeros(n, np.int64)
    for bit in reversed(range(bits)):
        for a in at:
            code = code << 1 | (a >> bit & 1)
    return np.argsort(code, kind="stable")


def _met(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each column of q the columns of p that are below it in every row; no two values of a row are equal.

    Blocks of neighbours are compared by their bounds, then a block's points by the bounds of the queries; only points
    that are neither in all of these queries nor in none are compared with each.
    """
    out = np.zeros(q.shape[1], np.int64)
    if not p.shape[1] or not q.shape[1]:
        return out
    p = np.ascontiguousarray(p[:, _curve(p[::2])])
    order = _curve(q[::2])
    starts = np.arange(0, p.shape[1], BLOCK)
    least, most = np.minimum.reduceat(p, starts, axis=1), np.maximum.reduceat(p, starts, axis=1)
    size = np.diff(np.append(starts, p.shape[1]))
    for at in range(0, len(order), BLOCK):
        now = order[at : at + BLOCK]
        some = q[:, now]
        low, high = some.min(axis=1)[:, None], some.max(axis=1)[:, None]
        meets, within = (least < high).all(axis=0), (most < low).all(axis=0)
        sure = int(size[within].sum())
        near = p.reshape(len(p), -1, BLOCK)[:, meets & ~within].reshape(len(p), -1) if p.shape[1] % BLOCK == 0 else p[:, np.repeat(meets & ~within, size)]
        near = near[:, (near < high).all(axis=0)]
        inner = (near < low).all(axis=0)
        sure += int(inner.sum())
        near = np.ascontiguousarray(near[:, ~inner])
        mask = near[0] < some[0][:, None]
        for k in range(1, len(p)):
            mask &= near[k] < some[k][:, None]
        out[now] = sure + np.count_nonzero(mask, axis=1)
    return out


def _tile(table: pa.Table, signs: Sequence[int], inclusive: Sequence[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a tile are queries, and their counts: values become places in one order of points and queries, in which equal ones stand as the half counts them."""
    point = table.column("point").to_numpy() == 1
    places = []
    for k, (sign, equal) in enumerate(zip(signs, inclusive)):
        v = table.column(f"v{k}").to_numpy()
        at = np.empty(len(v), np.int32)
        at[np.lexsort((point != equal, v))] = np.arange(len(v), dtype=np.int32)
        places.append(at if sign > 0 else len(v) - 1 - at)
    all_ = np.stack(places)
    return ~point, _met(all_[:, point], all_[:, ~point])


def _tiles(points: DataFrame, queries: DataFrame, axes: Sequence[Sequence[Half]], chunk: int) -> tuple[list[str], list[DataFrame], DataFrame]:
    """(names of the halves' columns, chunks of both sides, tiles) for any number of axes, each of a half that counts and one that takes off.

    Points and queries are cut into chunks by the first axis. Of two chunks the bounds, one row each, tell whether all meet,
    none do, or rows are to be compared: a task for two such chunks, in which nothing is larger than they are.
    """
    halves = [half for axis in axes for half in axis]
    names = [f"v{k}" for k in range(len(halves))]
    sides = []
    for point, df in ((1, points), (0, queries)):
        own = df.select("id", *[F.col(half[0] if point else half[1]).alias(v) for half, v in zip(halves, names)])
        own = in_ranges(own, ["v0"], max(1, -(-own.count() // chunk))).select("id", *names, F.col("range_no").alias("c"))
        sides.append(own)
    bounds = [df.groupBy("c").agg(F.count("*").alias("rows"), *[f(v).alias(f"{e}_{v}") for v in names for e, f in (("min", F.min), ("max", F.max))]) for df in sides]
    p, q = (b.select(*[F.col(c).alias(f"{x}_{c}") for c in b.columns]) for b, x in zip(bounds, "pq"))
    ends = [("max", "min") if half[3] > 0 else ("min", "max") for half in halves]
    less = lambda half, a, b: (a < b) if half[3] > 0 else (a > b)
    inside = functools.reduce(lambda a, b: a & b, [less(half, F.col(f"p_{e}_{v}"), F.col(f"q_{f}_{v}")) for half, v, (e, f) in zip(halves, names, ends)])
    outside = functools.reduce(lambda a, b: a | b, [less(half, F.col(f"q_{e}_{v}"), F.col(f"p_{f}_{v}")) for half, v, (e, f) in zip(halves, names, ends)])
    met = settled(p.crossJoin(q).where(~outside).select("p_c", "q_c", "p_rows", "q_rows", inside.alias("inside"), F.monotonically_increasing_id().alias("tile")))
    return names, sides, met


def _compared(sides: Sequence[DataFrame], met: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows of both sides in each tile whose rows are to be compared."""
    some = met.where("not inside")
    listed = [df.join(F.broadcast(some.select(F.col(c).alias("c"), "tile")), "c").select("tile", F.lit(point).alias("point"), *columns) for point, df, c in ((1, sides[0], "p_c"), (0, sides[1], "q_c"))]
    return listed[0].unionAll(listed[1])


def _tiled(points: DataFrame, queries: DataFrame, axes: Sequence[Sequence[Half]], chunk: int) -> DataFrame:
    """weighed() by tiles."""
    names, sides, met = _tiles(points, queries, axes, chunk)
    kind = queries.schema["id"].dataType.simpleString()
    signs, inclusive = [half[3] for axis in axes for half in axis], [half[2] for axis in axes for half in axis]

    def counts(t: pa.Table) -> pa.Table:
        query, n = _tile(t, signs, inclusive)
        return pa.table({"id": t.column("id").filter(pa.array(query)), "n": pa.array(n, pa.int64())})

    rows = _compared([sides[0].withColumn("id", F.lit(None).cast(kind)), sides[1]], met, ["id", *names])
    compared = rows.groupBy("tile").applyInArrow(counts, f"id {kind}, n bigint")
    whole = sides[1].join(F.broadcast(met.where("inside").groupBy(F.col("q_c").alias("c")).agg(F.sum("p_rows").alias("n"))), "c").select("id", "n")
    return compared.unionAll(whole).groupBy("id").agg(F.sum("n").alias("weight")).where("weight > 0")


def met_total(points: DataFrame, queries: DataFrame, axes: Sequence[Sequence[Half]], chunk: int | None = None) -> DataFrame:
    """(n): how many pairs of a point and a query meet on all axes, by tiles: one number leaves each tile, and tiles that meet whole are a product."""
    names, sides, met = _tiles(points, queries, axes, chunk or CHUNK)
    signs, inclusive = [half[3] for axis in axes for half in axis], [half[2] for axis in axes for half in axis]
    compared = _compared(sides, met, names).groupBy("tile").applyInArrow(lambda t: pa.table({"n": pa.array([int(_tile(t, signs, inclusive)[1].sum())], pa.int64())}), "n bigint")
    whole = met.where("inside").select((F.col("p_rows") * F.col("q_rows")).alias("n"))
    return compared.unionAll(whole).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
