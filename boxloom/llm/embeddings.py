"""Embedding near-dedup: an exact metric range join; pivots make cells, the triangle inequality says which vectors border on a cell."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import arrow_batches, components, given, groups_of, order_of, packed, stored, table, unpacked

THRESHOLD = 0.95
#: Home vectors of a group of cells that is aimed at, groups at least, rows of a tile on its two sides, products held at a time.
GROUP, GROUPS, HOME, MEMBER, PRODUCTS = 8192, 8, 8192, 1 << 16, 1 << 22
#: Angles are taken as equal within this; float32 cosines are checked again in double from so much below the threshold.
SLACK, COARSE = 1e-7, 1e-4


def comparable(v: Column) -> Column:
    """Whether a vector has a direction: not null or empty, all components finite numbers, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _angles(units: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Angles to all pivots, for some rows at a time."""
    step = max(1, PRODUCTS // max(1, len(pivots)))
    for s in range(0, len(units), step):
        rows = slice(s, min(s + step, len(units)))
        yield rows, np.arccos(np.clip(units[rows] @ pivots.T, -1, 1))


def _by_width(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of vectors of one dimension."""
    for batch in batches:
        width = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
        for w in np.unique(width):
            yield int(w), batch.filter(pa.array(width == w))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds node: 128 bits of a hash of the components."""
    for w, batch in _by_width(batches):
        flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, w) + 0.0  # no negative zeros
        node = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in flat]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.binary())], [*batch.schema.names, "node"])


@dataclass
class Cells:
    """The pivots of one dimension in order of their groups, each one's group and radius (the largest angle of its cell), and each group's blocks on both sides."""

    pivots: np.ndarray
    group: np.ndarray
    radius: np.ndarray
    homes: np.ndarray
    members: np.ndarray

    def borders(self, angle: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(home cell, which groups have a cell that may hold a vector within reach) for rows of angles to all pivots.

        A link from x to y in the cell of p: |xp| - |yp| <= reach, and |xp| - |xq| <= 2 * reach for x's own pivot q.
        """
        rows = np.arange(len(angle))
        home = angle.argmin(axis=1)
        near = (angle <= self.radius + reach + SLACK) & (angle - angle[rows, home][:, None] <= 2 * reach + SLACK)
        near[rows, home] = True
        first = np.flatnonzero(np.append(True, self.group[1:] != self.group[:-1]))
        return home, np.logical_or.reduceat(near, first, axis=1)


def _homes(batches: Iterator[pa.RecordBatch], cells: dict[int, Cells]) -> Iterator[pa.RecordBatch]:
    """For each batch the cells that vectors have their home in: the largest angle and the number of vectors."""
    for w, batch in _by_width(batches):
        for _, angle in _angles(_units(batch.column("v")), cells[w].pivots):
            home = angle.argmin(axis=1)
            own = angle[np.arange(len(home)), home]
            found = np.unique(home)
            most = [float(own[home == c].max()) for c in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), w)), pa.array(found), pa.array(most), pa.array(np.bincount(home)[found])], ["w", "cell", "r", "n"])


def _members(batches: Iterator[pa.RecordBatch], cells: dict[int, Cells], reach: float) -> Iterator[pa.RecordBatch]:
    """For each batch the number of its vectors that border on each group."""
    for w, batch in _by_width(batches):
        for _, angle in _angles(_units(batch.column("v")), cells[w].pivots):
            n = cells[w].borders(angle, reach)[1].sum(axis=0)
            g = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), w)), pa.array(g), pa.array(n[g])], ["w", "group", "n"])


def _deal(batches: Iterator[pa.RecordBatch], cells: dict[int, Cells], reach: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows of the tiles that a vector is compared in: its home block with every member block of its group, and its member block of each group that it borders on with every home block."""
    for w, batch in _by_width(batches):
        c = cells[w]
        vectors = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, w)
        raw = [x.tobytes() for x in vectors.astype(kind)]
        node = batch.column("node").to_pylist()
        lot = np.array([int.from_bytes(x[:4], "little") for x in node])
        for rows, angle in _angles(_units(batch.column("v")), c.pivots):
            home, near = c.borders(angle, reach)
            out = []
            for i, h, groups in zip(range(rows.start, rows.stop), home.tolist(), near):
                g = int(c.group[h])
                out += [(w, g, int(lot[i] % c.homes[g]), m, h, i) for m in range(c.members[g])]
                for g in np.flatnonzero(groups).tolist():
                    out += [(w, g, b, int(lot[i] % c.members[g]), -1, i) for b in range(c.homes[g])]
            for s in range(0, len(out), 4096):
                part = np.array(out[s : s + 4096])
                i = part[:, 5].tolist()
                columns = [*(pa.array(part[:, x]) for x in range(5)), batch.column("copies").take(pa.array(i)), pa.array([node[x] for x in i], pa.binary()), pa.array([raw[x] for x in i], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["w", "group", "hb", "mb", "cell", "copies", "node", "raw"])


def _compare(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Links of the home vectors of a tile, and the smallest node of each linked vector's component within the tile.

    Cell by cell: the members that may be within reach of a vector of the cell, by their angle to its pivot, meet all its vectors.
    """
    reach = math.acos(threshold)
    for tile in groups_of(batches, "tile"):
        tile = tile.combine_chunks()
        w = tile.column("w")[0].as_py()
        raw = np.frombuffer(b"".join(tile.column("raw").to_pylist()), kind).reshape(-1, w).astype(float)
        unit = raw / np.abs(raw).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        names = tile.column("node").to_pylist()
        known = {x: i for i, x in enumerate(sorted(set(names)))}
        node = np.array([known[x] for x in names])
        cell, copies = tile.column("cell").to_numpy(), tile.column("copies").to_numpy()
        homes, members = np.flatnonzero(cell >= 0), np.flatnonzero(cell < 0)
        if not len(homes) or not len(members):
            continue
        homes = homes[np.argsort(cell[homes], kind="stable")]
        cuts = np.flatnonzero(np.append(True, cell[homes][1:] != cell[homes][:-1]))
        outer, left, right = unit[members].astype(np.float32), [], []
        for own in np.split(homes, cuts[1:]):
            pivot = pivots[w][cell[own[0]]]
            angle = np.arccos(np.clip(unit[own] @ pivot, -1, 1))
            away = np.arccos(np.clip(unit[members] @ pivot, -1, 1))
            near = np.flatnonzero((away <= angle.max() + reach + SLACK) & (away >= angle.min() - reach - SLACK))
            inner = unit[own].astype(np.float32)
            step = max(1, PRODUCTS // len(own))
            for s in range(0, len(near), step):
                some = near[s : s + step]
                i, j = np.nonzero(inner @ outer[some].T >= threshold - COARSE)
                i, j = own[i], members[some[j]]
                fine = node[i] != node[j]
                i, j = i[fine], j[fine]
                for t in range(0, len(i), 65536):
                    a, b = i[t : t + 65536], j[t : t + 65536]
                    fine = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                    left.append(a[fine])
                    right.append(b[fine])
        i, j = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
        if not len(i):
            continue
        n = np.bincount(node[i], copies[j], len(known)).astype(np.int64)
        i, j = node[i], node[j]
        root = np.arange(len(known))
        while True:
            before = root.copy()
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
            if (root == before).all():
                break
        name = list(known)
        linked = np.unique(np.concatenate([i, j]))
        yield pa.RecordBatch.from_arrays([pa.array([name[x] for x in linked], pa.binary()), pa.array([name[x] for x in root[linked]], pa.binary()), pa.array(n[linked])], ["node", "root", "links"])


def _cells(classes: DataFrame, reach: float) -> dict[int, Cells]:
    """Pivots by dimension: the square root of the number of vectors, drawn by their hash, so cells and pivots both grow as slowly as they can."""
    cells = {}
    for row in classes.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).collect():
        w, n = row["w"], row["n"]
        drawn = classes.where(F.size("v") == w).select("node", "v").orderBy("node").limit(math.isqrt(n - 1) + 1).select("v").collect()
        pivots = _units(pa.array([r["v"] for r in drawn], pa.list_(pa.float64())))
        groups = min(len(pivots), max(GROUPS, -(-n // GROUP)))
        group = np.concatenate([a.argmin(axis=1) for _, a in _angles(pivots, pivots[:groups])])
        group = np.unique(group, return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        many = int(group.max()) + 1
        cells[w] = Cells(pivots[order], group[order], np.full(len(order), -math.inf), np.ones(many, int), np.ones(many, int))
    found = classes.mapInArrow(functools.partial(_homes, cells=cells), "w long, cell long, r double, n long").groupBy("w", "cell").agg(F.max("r").alias("r"), F.sum("n").alias("n")).collect()
    for w, c in cells.items():
        size = np.zeros(len(c.pivots), int)
        for row in found:
            if row["w"] == w:
                c.radius[row["cell"]], size[row["cell"]] = row["r"], row["n"]
        c.homes = np.maximum(1, -(-np.bincount(c.group, size, len(c.homes)).astype(int) // HOME))
    found = classes.mapInArrow(functools.partial(_members, cells=cells, reach=reach), "w long, group long, n long").groupBy("w", "group").agg(F.sum("n").alias("n")).collect()
    for row in found:
        cells[row["w"]].members[row["group"]] = max(1, -(-row["n"] // MEMBER))
    return cells


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept (and the columns in `keep`, whatever their names).

    Links join vectors of one dimension whose cosine in double precision is `threshold` or more; vectors that are null,
    empty, zero or hold null or non-finite components link with nothing. Equal vectors are compared once, as a class, and
    count each; rows that repeat a vec_id are vectors of their own; a null vec_id orders last. component_id is the smallest
    vec_id reachable; kept rows are their component's smallest. An empty table gives no row.

    Angles between directions are a metric, so the pivots' cells and the triangle inequality lose no link: each vector
    has its home in its nearest pivot's cell, and is replicated as a member to the cells that can hold a vector within
    reach. Neighbouring cells are dealt together, as groups of about GROUP vectors, so that a member of several goes once;
    a group's comparison is cut into tiles of home and member blocks. Within a tile, each cell meets the members within
    its reach. Only counts and one row per linked vector leave a tile, never pairs. There are as many pivots as the square
    root of the number of vectors; they, and a count per cell and group, are all that reaches the driver or is broadcast.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, 2000, 4)
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    rest = packed(("vec_id", *keep)).alias("rest")
    rows = vectors.select(*order_of(F.col("vec_id")), F.col("embedding").cast("array<double>").alias("v"), rest)
    classes = rows.where(comparable(F.col("v"))).groupBy("v").agg(F.min("id").alias("least"), F.min("none").alias("least_none"), F.count("*").alias("copies"))
    classes = stored(classes.mapInArrow(_named, "v array<double>, least long, least_none boolean, copies long, node binary"), "vectors")

    reach = math.acos(threshold)
    cells = _cells(classes, reach)
    deal = functools.partial(_deal, cells=cells, reach=reach, kind=kind)
    dealt = classes.select("v", "copies", "node").mapInArrow(deal, "w long, group long, hb long, mb long, cell long, copies long, node binary, raw binary")
    dealt = dealt.withColumn("tile", F.xxhash64("w", "group", "hb", "mb")).repartition("w", "group", "hb", "mb").sortWithinPartitions("tile")
    compare = functools.partial(_compare, pivots={w: c.pivots for w, c in cells.items()}, threshold=threshold, kind=kind)
    links = stored(dealt.mapInArrow(compare, "node binary, root binary, links long"), "links")

    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of = classes.join(counted, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = of.groupBy("root").agg(F.min("least").alias("c_id"), F.min("least_none").alias("c_none"))
    whole = of.join(least, "root").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "c_id", "c_none")
    out = rows.join(whole, "v", "left")
    c_id, c_none = F.coalesce("c_id", "id"), F.coalesce("c_none", "none")
    kept = (F.col("id") == c_id) & (F.col("none") == c_none)
    vec_id, *others = unpacked("rest", ("vec_id", *keep))
    return out.select(vec_id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), given(c_id, c_none).alias("component_id"), kept.alias("kept"), *others)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES, SQL = {"op3_embedding_near_dup": query}, {}
