"""Merkle manifest of a dataset: a mountain range per indexed piece of leaves, whose edges are merged until each group has one root."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .common import arrow_batches, stored, table

#: Nodes that become one node.
FANOUT = 3
#: Leaves of a piece, a row of about 2 MB; pieces, or results of a merge, that one merge takes together.
PIECE, MERGED = 3**9, 3**5
#: Leaves whose proofs make one Arrow batch.
PROOFS = 1024

Node = tuple[int, int, bytes]


def widths(n: int, fanout: int = FANOUT) -> list[int]:
    """The number of nodes at each level above n leaves, up to a single one."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


def hashed(run: Iterable[bytes]) -> bytes:
    """SHA-256 of digests as hexadecimal text."""
    return hashlib.sha256("".join([d.hex() for d in run]).encode()).digest()


def climb(nodes: Iterable[Node], width: list[int], fanout: int = FANOUT) -> tuple[list[Node], list[Node]]:
    """(made, left) from neighbouring nodes (level, index, digest), in the order of their leaves.

    The nodes go on a stack. The last node of a run carries: the run leaves the stack and its parent goes on it, which may
    carry in turn. A run's last node is its `fanout`-th, or the last one of its level, so short runs need no padding. A run
    that began elsewhere can't carry here: its nodes stay on the stack, with all that isn't complete yet.
    """
    made: list[Node] = []
    stack: list[Node] = []
    for node in nodes:
        stack.append(node)
        while True:
            level, index, _ = stack[-1]
            last, place = width[level] - 1, index % fanout
            if last == 0 or (place < fanout - 1 and index < last):
                break
            if len(stack) <= place or stack[-1 - place][:2] != (level, index - place):
                break
            parent = (level + 1, index // fanout, hashed(d for _, _, d in stack[-1 - place :]))
            del stack[-1 - place :]
            made.append(parent)
            stack.append(parent)
    return made, stack


def _deal(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (grp, row) to pieces (grp, part, no, rows): rows of one group, `most` at most."""
    part, no = TaskContext.get().partitionId(), 0
    held: list[pa.Array] = []
    of, size = None, 0

    def piece() -> pa.RecordBatch:
        rows = pa.concat_arrays(held)
        return pa.RecordBatch.from_arrays([pa.array([of], pa.string()), pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], ["grp", "part", "no", "rows"])

    for batch in batches:
        groups, rows = batch.column("grp").to_pylist(), batch.column("row")
        at = 0
        while at < len(groups):
            if size and (groups[at] != of or size == most):
                yield piece()
                held, size, no = [], 0, no + 1
            of, end = groups[at], at
            while end < len(groups) and groups[end] == of and size < most:
                end, size = end + 1, size + 1
            held.append(rows.slice(at, end - at))
            at = end
    if size:
        yield piece()


_NODE = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("seq", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.binary()), ("made", pa.bool_()), ("left", pa.bool_())])
_NODES = "grp string, n long, seq long, level int, index long, digest binary, made boolean, left boolean"


def _records(grp: str, n: int, seq: int, nodes: Iterable[Node], fanout: int) -> pa.RecordBatch:
    made, left = climb(nodes, widths(n, fanout), fanout)
    found = {x[:2]: [grp, n, seq, *x, True, False] for x in made}
    for x in left:
        found.setdefault(x[:2], [grp, n, seq, *x, False, False])[-1] = True
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found.values()), _NODE)], schema=_NODE)


def _climb_pieces(batches: Iterator[pa.RecordBatch], fanout: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for grp, n, seq, start, rows in zip(*(batch.column(c).to_pylist() for c in ("grp", "n", "seq", "start")), batch.column("rows")):
            leaves = rows.values.field("digest").to_pylist()
            yield _records(grp, n, seq, ((0, start + i, d) for i, d in enumerate(leaves)), fanout)


def _climb_merged(batches: Iterator[pa.RecordBatch], fanout: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for grp, n, seq, nodes in zip(*(batch.column(c).to_pylist() for c in ("grp", "n", "seq", "nodes"))):
            yield _records(grp, n, seq, ((x["level"], x["index"], x["digest"]) for x in nodes), fanout)


def _borders(start: int, size: int, width: list[int], fanout: int) -> Iterator[tuple[int, int]]:
    """(level, index) of the nodes in the runs of a piece's first and last node at each level, without those wholly inside the piece."""
    a, z = start, start + size - 1
    for level, w in enumerate(width[:-1]):
        for i in {*range(a - a % fanout, min(w, a - a % fanout + fanout)), *range(z - z % fanout, min(w, z - z % fanout + fanout))}:
            if not a < i < z:
                yield level, i
        a, z = a // fanout, z // fanout


def _needs(batches: Iterator[pa.RecordBatch], fanout: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [
            (grp, part, no, level, i)
            for grp, part, no, start, size, n in zip(*(batch.column(c).to_pylist() for c in ("grp", "part", "no", "start", "size", "n")))
            for level, i in _borders(start, size, widths(n, fanout), fanout)
        ]
        if out:
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["grp", "part", "no", "level", "index"])


def _prove(batches: Iterator[pa.RecordBatch], fanout: int) -> Iterator[pa.RecordBatch]:
    """Pieces with the nodes around them, to one row per leaf: grp, row, top, steps (the siblings before and after, level by level, and `up`)."""
    for batch in batches:
        rest = (batch.column(c).to_pylist() for c in ("grp", "n", "start", "outer", "up"))
        for i, (grp, n, start, outer, up, rows) in enumerate(zip(*rest, batch.column("rows"))):
            width, size = widths(n, fanout), len(rows)
            leaves = [(0, start + j, d) for j, d in enumerate(rows.values.field("digest").to_pylist())]
            node = {(x["level"], x["index"]): x["digest"].hex() for x in outer or ()}
            node |= {x[:2]: x[2].hex() for x in (*leaves, *climb(leaves, width, fanout)[0])}
            paths: dict[tuple[int, int], list[tuple[str, str]]] = {(len(width) - 1, 0): [(x["before"], x["after"]) for x in up or ()]}

            def path(level: int, at: int) -> list[tuple[str, str]]:
                if (level, at) not in paths:
                    first = at - at % fanout
                    run = [(k, node[level, k]) for k in range(first, min(width[level], first + fanout)) if k != at]
                    paths[level, at] = [("".join(d for k, d in run if k < at), "".join(d for k, d in run if k > at)), *path(level + 1, at // fanout)]
                return paths[level, at]

            for at in range(0, size, PROOFS):
                steps = [path(0, start + j) for j in range(at, min(size, at + PROOFS))]
                ends = [0, *itertools.accumulate(map(len, steps))]
                both = [pa.array([s[k] for x in steps for s in x], pa.string()) for k in (0, 1)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(both, ["before", "after"]))
                same = pa.array([i] * len(steps))
                yield pa.RecordBatch.from_arrays([batch.column("grp").take(same), rows.values.slice(at, len(steps)), batch.column("top").take(same), lists], ["grp", "row", "top", "steps"])


_STEPS = "array<struct<before:string,after:string>>"


class Trees:
    """One tree per group over leaves (grp, row), row a struct with a binary `digest`, in the order of `by` and digest.

    Rows equal in both are interchangeable. Leaves are dealt by ranges of (grp, by), so that neither a large group nor rows
    that repeat fill a task; each task cuts its range into pieces of PIECE leaves. A piece's place among the leaves of its
    group is a running sum over pieces, not rows. Each piece is a mountain range of its own; what its stack is left with, a
    few nodes per level, is merged MERGED pieces at a time, then MERGED merges at a time.
    """

    def __init__(self, leaves: DataFrame, by: list[Column], fanout: int = FANOUT, piece: int = PIECE, merged: int = MERGED):
        arrow_batches(leaves.sparkSession)
        self.fanout, self.row = fanout, leaves.schema["row"].dataType
        keys = {f"k{i}": c for i, c in enumerate([*by, F.col("row.digest"), F.monotonically_increasing_id()])}
        order = ["grp", *[F.col(k).asc_nulls_first() for k in keys]]
        sorted_ = leaves.select("grp", "row", *[c.alias(k) for k, c in keys.items()]).repartitionByRange(*order).sortWithinPartitions(*order).select("grp", "row")
        schema = StructType().add("grp", StringType()).add("part", IntegerType()).add("no", IntegerType()).add("rows", ArrayType(self.row))
        self.dealt = stored(sorted_.mapInArrow(functools.partial(_deal, most=piece), schema), "pieces")

        light = self.dealt.select("grp", "part", "no", F.size("rows").cast("long").alias("size"))
        so_far = Window.partitionBy("grp").orderBy("part", "no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = light.groupBy("grp").agg(F.sum("size").alias("n"), F.count("*").alias("pieces"))
        placed = light.withColumn("start", F.sum("size").over(so_far) - F.col("size")).withColumn("seq", F.count("*").over(so_far) - 1)
        self.placed = stored(placed.join(whole, "grp"), "places")
        at = self.dealt.join(self.placed.drop("size", "pieces"), ["grp", "part", "no"])
        pieces = stored(at.select("grp", "n", "seq", "start", "rows").mapInArrow(functools.partial(_climb_pieces, fanout=fanout), _NODES), "nodes")

        made, edges = [pieces.where("made")], pieces.where("left")
        between = [edges]  # the nodes that pieces have to know of each other
        most = self.placed.agg(F.max("pieces")).first()[0] or 0
        if most > 1:
            edges = edges.join(self.placed.where("pieces > 1").select("grp").distinct(), "grp", "left_semi")
        while most > 1:
            place = (F.col("index") * F.pow(F.lit(float(fanout)), F.col("level")).cast("long")).alias("place")
            units = edges.groupBy("grp", "n", F.expr(f"seq div {merged}").alias("seq")).agg(F.sort_array(F.collect_list(F.struct(place, "level", "index", "digest"))).alias("nodes"))
            met = stored(units.mapInArrow(functools.partial(_climb_merged, fanout=fanout), _NODES), "merged")
            made.append(met.where("made"))
            between.append(made[-1])
            edges, most = met.where("left"), -(-most // merged)
        self._made, self._between = (functools.reduce(DataFrame.unionAll, x).select("grp", "level", "index", "digest") for x in (made, between))

    def nodes(self) -> DataFrame:
        """(grp, level, index, digest): the node records, every node above the leaves once."""
        return self._made

    def roots(self) -> DataFrame:
        """(grp, digest): the root of each tree; a lone leaf is one."""
        return self._between.groupBy("grp").agg(F.max(F.struct("level", "digest")).alias("root")).select("grp", "root.digest")

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """(grp, row, top, steps): for each leaf the siblings before and after it and each ancestor, as joined hexadecimal digests.

        `above` (grp, top, up), a row per group, has further steps that follow the group's root.
        """
        needs = self.placed.select("grp", "part", "no", "start", "size", "n").mapInArrow(functools.partial(_needs, fanout=self.fanout), "grp string, part int, no int, level int, index long")
        outer = needs.join(self._between, ["grp", "level", "index"]).groupBy("grp", "part", "no").agg(F.collect_list(F.struct("level", "index", "digest")).alias("outer"))
        light = self.placed.select("grp", "part", "no", "n", "start").join(outer, ["grp", "part", "no"], "left")
        light = light.join(above, "grp") if above is not None else light.select("*", F.lit(None).cast("string").alias("top"), F.lit(None).cast(_STEPS).alias("up"))
        schema = StructType().add("grp", StringType()).add("row", self.row).add("top", light.schema["top"].dataType)
        schema = schema.add(light.select(F.col("up").alias("steps")).schema["steps"])
        at = self.dealt.join(light, ["grp", "part", "no"]).select("grp", "n", "start", "outer", "up", "top", "rows")
        return at.mapInArrow(functools.partial(_prove, fanout=self.fanout), schema)


def field(c: Column) -> Column:
    """A value as part of a leaf: '-' for null, else the number of its UTF-8 bytes, ':' and itself."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(steps, start, lambda x, s: F.sha2(F.concat(s["before"], x, s["after"]), 256))


def siblings(steps: Column) -> Column:
    """All siblings of a proof, joined."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", by: str = "doc_id", changed: Column | None = None, **sizes: int) -> DataFrame:
    """For each row of docs: doc_id (`by`), leaf, subroot, root, steps, and changed, the leaf of another form of the row.

    A leaf is the SHA-256 of `columns`; a tree of leaves by `by` stands for each value of `group`, a tree of their roots in
    the bytewise order of `group` for the table. steps are a leaf's siblings on the way to the root: folded(leaf, steps) is
    the root if the row is as it was. A null group comes first, a null `by` first in its group; ties of `by` are in the
    order of their digests, rows that repeat are leaves of their own; empty texts are not null ones; an empty table gives no
    row; other columns are not read, whatever their names. Texts are hashed where they are read and never shuffled; a text
    is held whole for that. Digests are dealt by ranges, a third of the table in one group too.
    """
    col = lambda c: F.col(f"`{c}`")
    grp = F.coalesce(F.concat(F.lit("="), col(group).cast("string")), F.lit(""))
    other = F.unhex(changed) if changed is not None else F.lit(None).cast("binary")
    row = F.struct(col(by).alias("doc_id"), F.unhex(leaf([col(c) for c in columns])).alias("digest"), other.alias("changed"))
    trees = Trees(stored(docs.select(grp.alias("grp"), row.alias("row")), "leaves"), [F.col("row.doc_id")], **sizes)
    table_ = Trees(trees.roots().select(F.lit("").alias("grp"), F.struct(F.col("grp").alias("of"), "digest").alias("row")), [F.col("row.of")], **sizes)
    root = table_.roots().select("grp", F.lower(F.hex("digest")).alias("root"))
    above = table_.proofs().join(root, "grp").select(F.col("row.of").alias("grp"), F.struct(F.lower(F.hex("row.digest")).alias("subroot"), "root").alias("top"), F.col("steps").alias("up"))
    hexed = lambda c: F.lower(F.hex(c))
    return trees.proofs(stored(above, "above")).select("row.doc_id", hexed("row.digest").alias("leaf"), "top.subroot", "top.root", "steps", hexed("row.changed").alias("changed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stripped = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf(stripped))
    found = manifest(docs, changed=tampered)
    got = folded(F.coalesce("changed", "leaf"), F.col("steps"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"), got.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda a, v: xor(xor(a, v) >> 1, (xor(a, v) & 1) * 3988292384)))"
_FIELD = "coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
_LEAF = " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
ORACLE = f"""
with recursive d as (select row_number() over () as r, doc_id, coalesce('=' || source, '') as grp, sha256({_LEAF.format(text="text")}) as leaf,
    case when {_CRC} % 2 = 0 then sha256({_LEAF.format(text="replace(text, chr(10), '')")}) else sha256({_LEAF.format(text="text")}) end as now from documents),
o as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by grp) as n from d),
t(grp, level, i, n, digest) as (
    select grp, 0, i, n, leaf from o
    union all select grp, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' order by i)) from t where n > 1 group by grp, level, n, i // 3),
top as (select grp, digest as subroot, row_number() over (order by grp) - 1 as i, count(*) over () as n from t where n = 1),
u(level, i, n, digest) as (
    select 0, i, n, subroot from top
    union all select level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' order by i)) from u where n > 1 group by level, n, i // 3),
a as (select grp, level, i, n, digest from t union all select null, level, i, n, digest from u),
s as (select x.grp, x.level, x.i, coalesce(string_agg(y.digest, '' order by y.i) filter (where y.i < x.i), '') as before, coalesce(string_agg(y.digest, '' order by y.i) filter (where y.i > x.i), '') as after
      from a x join a y on x.grp is not distinct from y.grp and x.level = y.level and x.i // 3 = y.i // 3 where x.n > 1 group by x.grp, x.level, x.i),
f(r, level, i, n, grp, now, proof) as (
    select r, 0, i, n, grp, now, '' from o
    union all select f.r, f.level + 1, f.i // 3, (f.n + 2) // 3, f.grp, sha256(s.before || f.now || s.after), f.proof || s.before || s.after
    from f join s on f.grp = s.grp and f.level = s.level and f.i = s.i where f.n > 1),
g(r, level, i, n, now, proof) as (
    select r, 0, top.i, top.n, now, proof from f join top using (grp) where f.n = 1
    union all select g.r, g.level + 1, g.i // 3, (g.n + 2) // 3, sha256(s.before || g.now || s.after), g.proof || s.before || s.after
    from g join s on s.grp is null and g.level = s.level and g.i = s.i where g.n > 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified
from d join (select r, now as folded, proof from g where n = 1) using (r) join top using (grp) cross join (select digest as root from u where n = 1)
"""
QUERIES, SQL = {"op11_merkle_manifest": query}, {"op11_merkle_manifest": ORACLE}
