"""The join as disjoint blocks: equi-joins on dyadic nodes of ranks, then a merge on the last axis; W without listing pairs.

On each axis a pair is owned by R if R's lower endpoint is at or before S's, else by S, so the 2^d orientations are
disjoint. On all axes but the last, the owning side's extent is an interval of ranks of the other side's lower endpoints:
it is cut into canonical dyadic nodes, and the other side's point lies in exactly one of them. Boxes that agree on the
nodes of all leading axes meet in one group, where the last axis is a sorted merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxes import BoxJoin
from .dominance import begun_in, met_total, overlap, weighed
from .prefix import ROWS, counts_at, hot_groups, ranked, running, segmented
from .storage import settled


def height_of(join: BoxJoin) -> int:
    """The height of the trees of ranks, log2 of the larger side: with it an interval takes two nodes per height at most."""
    return max(1, *((df.count() - 1).bit_length() for df in (join.r, join.s)))


def rank_intervals(source: DataFrame, lattice: DataFrame, axis: int, source_is_r: bool) -> DataFrame:
    """source(id) -> (id, lo, hi, u): the ranks of the lattice's lower endpoints that lie in each box on the axis, and its upper end.

    R takes S's points in [l, u), S takes R's points in (l, u).
    """
    lower, upper = f"l{axis}", f"u{axis}"
    points = lattice.select(F.col(lower).alias("x"))
    at = source.select("id", F.col(lower).alias("x"), F.lit(not source_is_r).alias("inclusive"), F.lit("lo").alias("end")).unionAll(
        source.select("id", F.col(upper).alias("x"), F.lit(False).alias("inclusive"), F.lit("hi").alias("end"))
    )
    found = counts_at(points, at)
    pick = lambda e: F.max(F.when(F.col("end") == e, F.col("n_below")))
    return found.groupBy("id").agg(pick("lo").alias("lo"), pick("hi").alias("hi"), F.max(F.when(F.col("end") == "hi", F.col("x"))).alias("u")).where("lo < hi")


def _node(orient: int, h, index):
    return F.lit(orient).cast("bigint") * F.lit(1 << 60).cast("bigint") + h.cast("bigint") * F.lit(1 << 50).cast("bigint") + index


def canonical(orient: int, height: int):
    """Array of the canonical nodes of [lo, hi): at most two per height below the top, all of the top's in between (one, at full height)."""
    two = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), h)
    left = lambda h: F.call_function("div", F.col("lo") + two(h) - 1, two(h))
    right = lambda h: F.call_function("div", F.col("hi"), two(h))

    def at(h):
        l, r = left(h), right(h)
        some = l < r
        return F.array(F.when(some & (l % 2 == 1), _node(orient, h, l)), F.when(some & (r % 2 == 1), _node(orient, h, r - 1)))

    low = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), at))
    top = F.lit(height)
    l, r = left(top), right(top)
    high = F.when(l < r, F.transform(F.sequence(l, r - 1), lambda i: _node(orient, top, i))).otherwise(F.array().cast("array<bigint>"))
    return F.filter(F.concat(low, high), lambda x: x.isNotNull())


def ancestors(orient: int, rank: str = "rank", *, height: int):
    return F.transform(F.sequence(F.lit(0), F.lit(height)), lambda h: _node(orient, h, F.call_function("shiftright", F.col(rank), h.cast("int"))))


def node_of(orient: Column, lo: Column, hi: Column, rank: Column, height: int) -> Column:
    """The one canonical node of [lo, hi) that is above the rank: the highest that the interval holds."""
    first = lambda h: F.call_function("shiftright", rank, h.cast("int"))
    at = lambda x, h: F.call_function("shiftleft", x, h.cast("int"))
    h = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(height)), lambda h: (at(first(h), h) >= lo) & (at(first(h) + 1, h) <= hi)))
    return orient.cast("bigint") * F.lit(1 << 60).cast("bigint") + h.cast("bigint") * F.lit(1 << 50).cast("bigint") + first(h)


def ranked_sides(join: BoxJoin) -> BoxJoin:
    """Both sides with, for each axis but the last, the place in their side's order (rank0, ..) and the interval of the other's places that they hold (lo0, hi0, ..)."""
    j, out = join.clean(), []
    for own, other, is_r in ((j.r, j.s, True), (j.s, j.r, False)):
        each = own
        for axis in range(j.d - 1):
            rank = ranked(own.select(f"l{axis}", "id"), [f"l{axis}", "id"]).select("id", F.col("rank").alias(f"rank{axis}"))
            span = rank_intervals(own, other, axis, is_r).select("id", F.col("lo").alias(f"lo{axis}"), F.col("hi").alias(f"hi{axis}"))
            each = each.join(rank, "id").join(span, "id", "left")
        out.append(settled(each))
    return BoxJoin(*out)


def pair_keys(d: int, height: int) -> list[Column]:
    """The group keys k0, .. of the pair in a row of both sides (r_, s_) of ranked_sides()."""
    out = []
    for k in range(d - 1):
        first = F.col(f"r_l{k}") <= F.col(f"s_l{k}")
        of = lambda r, s, first=first: F.when(first, F.col(r)).otherwise(F.col(s))
        out.append(node_of(F.when(first, 0).otherwise(1), of(f"r_lo{k}", f"s_lo{k}"), of(f"r_hi{k}", f"s_hi{k}"), of(f"s_rank{k}", f"r_rank{k}"), height).alias(f"k{k}"))
    return out


def _routed(r: DataFrame, s: DataFrame, base: BoxJoin, axis: int, keys: list[str], height: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with one more key: for each orientation the owner's canonical nodes and the other's ancestors, where both meet.

    Intervals and ranks are those of the whole sides (`base`): nodes of one tree serve all groups.
    """
    key, sides = f"k{axis}", []
    for orient, (source, lattice, all_source, all_lattice) in enumerate(((r, s, base.r, base.s), (s, r, base.s, base.r))):
        where = rank_intervals(all_source, all_lattice, axis, orient == 0)
        ranks = ranked(all_lattice.select(f"l{axis}", "id"), [f"l{axis}", "id"]).select("id", "rank")
        own = source.join(where, "id").withColumn(key, F.explode(canonical(orient, height))).drop("lo", "hi", "u")
        nodes = own.select(*keys, key).distinct()
        other = lattice.join(ranks, "id").withColumn(key, F.explode(ancestors(orient, height=height))).drop("rank").join(nodes, [*keys, key], "left_semi")
        sides.append((own, other))
    columns = [*r.columns, key]
    return sides[0][0].select(columns).unionAll(sides[1][1].select(columns)), sides[0][1].select(columns).unionAll(sides[1][0].select(columns))


def grouped(join: BoxJoin, height: int | None = None) -> DataFrame:
    """(keys, side, id, l, u): the boxes of both sides in each group of nodes, with their ends on the last axis; for d > 1."""
    j = join.clean()
    height = height or height_of(j)
    d, last = j.d, j.d - 1
    keep = ["id", *[f"{e}{k}" for k in range(d) for e in "lu"]]
    r, s, keys = j.r.select(keep), j.s.select(keep), []
    for axis in range(last):
        r, s = _routed(r, s, j, axis, keys, height)
        keys.append(f"k{axis}")
        if last > 1:  # each axis reads the last one's rows several times
            r, s = settled(r), settled(s)
    return r.select(*keys, F.lit(0).alias("side"), "id", F.col(f"l{last}").alias("l"), F.col(f"u{last}").alias("u")).unionAll(
        s.select(*keys, F.lit(1).alias("side"), "id", F.col(f"l{last}").alias("l"), F.col(f"u{last}").alias("u"))
    )


def atoms(join: BoxJoin, height: int | None = None, store: bool = False, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(atoms, lists): blocks (keys, anchor_side, anchor_id, lo, hi, u, weight), and (keys, side, id, x, rank) of the boxes that lo..hi index.

    A block pairs its anchor with the opposite boxes of its group whose rank, by lower endpoint x of the last axis, is in
    [lo, hi); u is its anchor's upper endpoint there. Blocks are disjoint and their weights add up to W. With `store`, both
    come from one checkpoint. Groups of more than `rows` boxes are cut into ranges.
    """
    j = join.clean()
    if j.d == 1:
        blocks, lists = _flat_atoms(j.r, j.s)
        return (settled(blocks), settled(lists)) if store else (blocks, lists)
    return merged(settled(grouped(j, height)), store, rows)


def merged(both: DataFrame, store: bool = False, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """The blocks and lists of groups (written boxes of grouped()): a sorted pass over the last axis of each."""
    keys = keys_of(both)
    # queries at R's ends precede equal points; S's lower end follows R's equal points, its upper end precedes them
    row = lambda x, tie, what: F.struct(F.col(x).alias("x"), F.lit(tie).alias("tie"), F.lit(what).alias("what"))
    lists_of = F.when(F.col("side") == 0, F.array(row("l", 0, "lo"), row("u", 0, "hi"), row("l", 1, "point"))).otherwise(F.array(row("l", 2, "lo"), row("u", 0, "hi"), row("l", 1, "point")))
    e = both.withColumn("e", F.explode(lists_of)).select(*keys, "side", "id", "e.*")
    points = lambda side: F.when((F.col("what") == "point") & (F.col("side") == side), 1).otherwise(0).cast("bigint")
    e = segmented(e, keys, ["x", "tie", "side", "id"], {"r_before": points(0), "s_before": points(1)}, hot_groups(both, keys, rows), rows)
    e = settled(e) if store else e
    opposite, own = F.when(F.col("side") == 0, F.col("s_before")).otherwise(F.col("r_before")), F.when(F.col("side") == 0, F.col("r_before")).otherwise(F.col("s_before"))
    pick = lambda what, c: F.max(F.when(F.col("what") == what, c))
    ends = e.where("what <> 'point'").groupBy(*keys, F.col("side").alias("anchor_side"), F.col("id").alias("anchor_id"))
    found = ends.agg(pick("lo", opposite).alias("lo"), pick("hi", opposite).alias("hi"), pick("hi", F.col("x")).alias("u"))
    blocks = found.where("lo < hi").withColumn("weight", F.col("hi") - F.col("lo"))
    return blocks, e.where("what = 'point'").select(*keys, "side", "id", "x", own.alias("rank"))


def _flat_atoms(r: DataFrame, s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One axis: the whole sides are the one group, so ranks come from ranges instead of a window over a group."""
    def side(source: DataFrame, lattice: DataFrame, number: int) -> DataFrame:
        return rank_intervals(source, lattice, 0, number == 0).select(F.lit(number).alias("anchor_side"), F.col("id").alias("anchor_id"), "lo", "hi", "u", (F.col("hi") - F.col("lo")).alias("weight"))

    listed = [ranked(x.select("l0", "id"), ["l0", "id"]).select(F.lit(n).alias("side"), "id", F.col("l0").alias("x"), "rank") for n, x in enumerate((r, s))]
    return side(r, s, 0).unionAll(side(s, r, 1)), listed[0].unionAll(listed[1])


def keys_of(blocks: DataFrame) -> list[str]:
    return [c for c in blocks.columns if c[0] == "k" and c[1:].isdigit()]


def exact_total(blocks: DataFrame) -> DataFrame:
    """W by adding up weights, as decimal(38, 0)."""
    return blocks.agg(F.coalesce(F.sum(F.col("weight").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("w"))


def total(blocks: DataFrame) -> DataFrame:
    """W as a bigint; a greater one is an error, and exact_total() has it."""
    return exact_total(blocks).select(F.col("w").cast("bigint").alias("w"))


def total_counted(join: BoxJoin) -> DataFrame:
    """total() of atoms(). On three axes and more, where a box has log^(d-1) rows in blocks, the anchors' partners are counted by tiles instead: one number leaves each tile."""
    j = join.clean()
    if j.d <= 2:
        return total(atoms(j)[0])
    rest, last = [overlap(k) for k in range(j.d - 1)], j.d - 1
    sides = met_total(j.s, j.r, [*rest, begun_in(last, True)]).unionAll(met_total(j.r, j.s, [*rest, begun_in(last, False)]))
    return sides.agg(F.sum("n").cast("bigint").alias("w"))


def owner_of(blocks: DataFrame, sweep: bool) -> Column:
    """The side that owns a block's pairs: R, or with `sweep` the side whose boxes start later on axis 0."""
    if not sweep:
        return F.lit(0)
    if not keys_of(blocks):
        return 1 - F.col("anchor_side")
    return F.when(F.call_function("div", F.col("k0"), F.lit(1 << 60).cast("bigint")) == 0, 1).otherwise(0)


def entries(blocks: DataFrame, lists: DataFrame, sweep: bool = False, rows: int = ROWS) -> DataFrame:
    """(keys, side, owner_id, own, lo, x, weight): how many pairs an owner has in each group, by its own block there (own = 0) or as a member of others' blocks (1).

    A member's pairs are the opposite blocks that cover its rank: a running sum over the blocks' ends, so pairs are never
    listed. Groups of more than `rows` rows are cut into ranges.
    """
    keys, owner, kind = keys_of(blocks), owner_of(blocks, sweep), dict(lists.dtypes)
    member = [*keys, "member"]
    first = blocks.where(F.col("anchor_side") == owner).select(*keys, F.col("anchor_side").alias("side"), F.col("anchor_id").alias("owner_id"), F.lit(0).alias("own"), "lo", F.lit(None).cast(kind["x"]).alias("x"), "weight")
    other = blocks.where(F.col("anchor_side") != owner).select(*keys, (1 - F.col("anchor_side")).alias("member"), "lo", "hi")
    null = [F.lit(None).cast(kind[c]).alias(c) for c in ("id", "x")]
    ends = [other.select(*member, F.col(c).alias("rank"), F.lit(0).alias("tie"), F.lit(n).cast("bigint").alias("step"), *null) for c, n in (("lo", 1), ("hi", -1))]
    ranks = lists.select(*keys, F.col("side").alias("member"), "rank", F.lit(1).alias("tie"), F.lit(0).cast("bigint").alias("step"), "id", "x")
    ranks = ranks.join(other.select(*member).distinct(), member, "left_semi").select(ends[0].columns)
    run = ends[0].unionAll(ends[1]).unionAll(ranks)
    if keys:
        covered = segmented(run, member, ["rank", "tie"], {"weight": F.col("step")}, hot_groups(run, member, rows), rows, before=False)
    else:  # the whole sides: a sum over members one after the other, in which each one's steps end at zero
        covered = running(run, ["member", "rank", "tie"], {"weight": F.col("step")}, rows, before=False)
    covered = covered.where("tie = 1 and weight > 0")
    return first.unionByName(covered.select(*keys, F.col("member").alias("side"), F.col("id").alias("owner_id"), F.lit(1).alias("own"), F.col("rank").alias("lo"), "x", "weight"))


def pairs_of(blocks: DataFrame, lists: DataFrame, sweep: bool = False) -> DataFrame:
    """(side, owner_id, weight): how many pairs each R box has, or with `sweep` each box that starts later on axis 0."""
    return entries(blocks, lists, sweep).groupBy("side", "owner_id").agg(F.sum("weight").alias("weight"))


def anchor_weights(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("anchor_side", "anchor_id").agg(F.sum("weight").alias("weight"))


def anchors_counted(join: BoxJoin) -> DataFrame:
    """anchor_weights() without blocks: an anchor's partners begin within it on the last axis and meet it on the others."""
    j = join.clean()
    rest, last = [overlap(k) for k in range(j.d - 1)], j.d - 1
    sides = [weighed(j.s, j.r, [*rest, begun_in(last, True)]), weighed(j.r, j.s, [*rest, begun_in(last, False)])]
    return sides[0].select(F.lit(0).alias("anchor_side"), F.col("id").alias("anchor_id"), "weight").unionAll(sides[1].select(F.lit(1).alias("anchor_side"), F.col("id").alias("anchor_id"), "weight"))


def node_weights(blocks: DataFrame) -> DataFrame:
    """Pairs of each node of the first axis: height and index are digits of the key."""
    return blocks.groupBy("k0").agg(F.sum("weight").alias("weight"))
