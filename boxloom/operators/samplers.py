"""Exact uniform samples of join pairs: ordered, independent, with replacement, a function of (seed, query_id) alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.random import uniform_below
from . import decompose
from .boxes import BoxJoin
from .dominance import overlap, weighed
from .joins import grid_pairs, widths
from .levels import Levels
from .prefix import counts_at, hot_groups, ranked, running, segmented
from .storage import settled
from .sweep import owner_side, weights

KINDS = ("compiled", "replay", "sweep", "lifted")
OK, EMPTY = "OK", "EMPTY-JOIN"
#: Draws whose boxes are broadcast.
FEW = 1 << 14


def draws(spark: SparkSession, domain: str, t: int, bound: int | Column, query_id: int = 0) -> DataFrame:
    """(pos, g): t independent integers below the bound."""
    return spark.range(t).select(F.col("id").alias("pos"), uniform_below(domain, F.col("id"), bound, query_id).alias("g"))


def picked(drawn: DataFrame, blocks: DataFrame, order: list[str], w: int, slots: int = 1 << 16) -> DataFrame:
    """Each draw g with the block whose running weight covers it, and the offset in it (g less the weights before).

    Weights in `order` cut [0, W) into intervals. Equal slots of [0, W) are the join key; a block is listed in each slot
    that it covers, and within a slot one ordered pass carries the last block to the draws after it.
    """
    size = max(1, -(-w // slots))
    summed = running(blocks, order, {"first": F.col("weight")})
    fields = summed.columns
    slot = F.explode(F.sequence(F.call_function("div", F.col("first"), F.lit(size).cast("bigint")), F.call_function("div", F.col("first") + F.col("weight") - 1, F.lit(size).cast("bigint"))))
    kind = F.struct(*fields)
    left = summed.select(slot.alias("slot"), F.col("first").alias("x"), F.lit(0).alias("tie"), F.lit(None).cast("bigint").alias("pos"), kind.alias("block"))
    right = drawn.select(F.call_function("div", F.col("g"), F.lit(size).cast("bigint")).alias("slot"), F.col("g").alias("x"), F.lit(1).alias("tie"), "pos", F.lit(None).cast(summed.schema.simpleString()).alias("block"))
    over = Window.partitionBy("slot").orderBy("x", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = left.unionAll(right).withColumn("block", F.last("block", ignorenulls=True).over(over)).where("pos is not null")
    return found.select("pos", "block.*", (F.col("x") - F.col("block.first")).alias("offset")).drop("first")


class Sampler:
    """count() is W; sample(t, query_id) gives (pos, r_id, s_id), no row if the join is empty; status(t) says which."""

    kind = ""

    def __init__(self, join: BoxJoin, seed: str):
        self.join, self.seed = join.clean(), seed
        self.spark = join.r.sparkSession
        self._w: int | None = None

    def domain(self) -> str:
        """Kinds draw from streams of their own."""
        return f"{self.seed}:{self.kind}"

    def _count(self) -> int:
        raise NotImplementedError

    def count(self) -> int:
        self._w = self._count() if self._w is None else self._w
        return self._w

    def status(self, t: int) -> str:
        return OK if t == 0 or self.count() else EMPTY

    def sample(self, t: int, query_id: int = 0) -> DataFrame:
        w = self.count()
        if not t or not w:
            return self._empty()
        return self._sample(draws(self.spark, self.domain(), t, w, query_id), w)

    def _empty(self) -> DataFrame:
        kind = dict(self.join.r.dtypes)["id"]
        return self.spark.createDataFrame([], f"pos bigint, r_id {kind}, s_id {kind}")

    def _sample(self, drawn: DataFrame, w: int) -> DataFrame:
        raise NotImplementedError


class _Anchored(Sampler):
    """Draws fall to boxes by their numbers of pairs, which are counted without a pair for d > 1.

    The partners of the boxes that were drawn are listed in the order of the decomposition while they are no more than the
    rows of all blocks would be; else the blocks are made.
    """

    _counted: DataFrame | None = None
    _ranks: BoxJoin | None = None
    order = ["owner_id", "side"]

    def _weigh(self) -> DataFrame:
        raise NotImplementedError

    @property
    def weights(self) -> DataFrame:
        """(side, owner_id, weight) of the boxes with pairs."""
        if self._counted is None:
            self._counted = settled(self._weigh())
        return self._counted

    def _count(self) -> int:
        return int(decompose.exact_total(self.weights).first()["w"])

    def _owner(self) -> Column:
        """The side of the box that a pair (r_, s_) falls to."""
        raise NotImplementedError

    def _found(self, drawn: DataFrame, w: int) -> tuple[DataFrame, bool]:
        """(pos, side, owner_id, place) of each draw, and whether the partners of all drawn boxes are few enough to be listed."""
        found = settled(picked(drawn, self.weights, self.order, w).select("pos", "side", "owner_id", F.col("offset").alias("place"), "weight"))
        if self.join.d == 1:
            return found, False
        pairs = found.dropDuplicates(["side", "owner_id"]).agg(F.sum(F.col("weight").cast("decimal(38,0)"))).first()[0]
        boxes = self.join.r.count() + self.join.s.count()
        return found, pairs <= boxes * decompose.height_of(self.join) ** (self.join.d - 1)

    def _listed(self, found: DataFrame) -> DataFrame:
        """The pair of each draw, from the partners of drawn boxes, numbered as the decomposition has them: by own blocks, groups and ends."""
        d, last = self.join.d, self.join.d - 1
        height = decompose.height_of(self.join)
        self._ranks = self._ranks or decompose.ranked_sides(self.join)
        width, keys, parts = widths(self.join, min(d, 2)), [f"k{k}" for k in range(last)], []
        few = found.count() <= FEW
        for side in [x["side"] for x in found.select("side").distinct().collect()]:
            drawn = found.where(F.col("side") == side).select(F.col("owner_id").alias("id")).distinct()
            own = (self._ranks.r, self._ranks.s)[side].join(F.broadcast(drawn) if few else drawn, "id", "left_semi")
            own = F.broadcast(own) if few else own
            met = grid_pairs(BoxJoin(own, self._ranks.s) if side == 0 else BoxJoin(self._ranks.r, own), width=width).where(self._owner() == side)
            a, b = ("r", "s") if side == 0 else ("s", "r")
            anchor = F.when(F.col(f"r_l{last}") <= F.col(f"s_l{last}"), 0).otherwise(1)
            end = F.when(anchor == side, F.col(f"{b}_l{last}")).otherwise(F.col(f"{b}_u{last}"))
            parts.append(met.select(F.lit(side).alias("side"), F.col(f"{a}_id").alias("owner_id"), F.col(f"{b}_id").alias("other"), (anchor != side).alias("member"), *decompose.pair_keys(d, height), end.alias("end")))
        by = Window.partitionBy("side", "owner_id").orderBy("member", *keys, "end", "other")
        listed = reduce(DataFrame.unionAll, parts).select("side", "owner_id", "other", (F.row_number().over(by) - 1).cast("bigint").alias("place"))
        return _pairs(listed.join(F.broadcast(found) if few else found, ["side", "owner_id", "place"]))


def _pairs(found: DataFrame) -> DataFrame:
    owner = F.col("side") == 0
    return found.select("pos", F.when(owner, F.col("owner_id")).otherwise(F.col("other")).alias("r_id"), F.when(owner, F.col("other")).otherwise(F.col("owner_id")).alias("s_id"))


class Compiled(_Anchored):
    """A draw finds its anchor by the anchors' weights, then the block, then the opposite box at lo + offset. Blocks, where they are needed, are written once."""

    kind = "compiled"
    _made: tuple[DataFrame, DataFrame] | None = None

    @property
    def blocks(self) -> DataFrame:
        return self._blocks()[0]

    def _blocks(self) -> tuple[DataFrame, DataFrame]:
        self._made = self._made or decompose.atoms(self.join, store=True)
        return self._made

    def prepare(self) -> Compiled:
        self.weights  # noqa: B018
        return self

    def _weigh(self) -> DataFrame:
        own = decompose.anchor_weights(self.blocks) if self.join.d == 1 else decompose.anchors_counted(self.join)
        return own.select(F.col("anchor_side").alias("side"), F.col("anchor_id").alias("owner_id"), "weight")

    def _owner(self) -> Column:
        last = self.join.d - 1
        return F.when(F.col(f"r_l{last}") <= F.col(f"s_l{last}"), 0).otherwise(1)

    def _sample(self, drawn: DataFrame, w: int) -> DataFrame:
        if self.join.d > 1:
            found, few = self._found(drawn, w)
            if few:
                return self._listed(found)
        blocks, lists = self._blocks()
        found = picked(drawn, blocks, ["anchor_id", "anchor_side", *decompose.keys_of(blocks)], w)
        return _resolved(found, lists)


def _resolved(found: DataFrame, lists: DataFrame) -> DataFrame:
    """The pair of each draw: the block's anchor, and the opposite box of its group at lo + offset."""
    keys = decompose.keys_of(lists)
    want = found.select("pos", *keys, "anchor_side", "anchor_id", (1 - F.col("anchor_side")).alias("side"), (F.col("lo") + F.col("offset")).alias("rank"))
    met = want.join(lists, [*keys, "side", "rank"])
    r = F.when(F.col("anchor_side") == 0, F.col("anchor_id")).otherwise(F.col("id"))
    s = F.when(F.col("anchor_side") == 0, F.col("id")).otherwise(F.col("anchor_id"))
    return met.select("pos", r.alias("r_id"), s.alias("s_id"))


class Replay(Sampler):
    """Blocks aren't kept: nodes are weighed, draws fall to nodes, and only nodes with draws have their blocks formed again.

    For d > 1 a node is a group of the decomposition. On one axis it is a run of 2^RUN anchors of one side by their lower ends.
    """

    kind, RUN = "replay", 8
    _weighed: tuple[DataFrame, DataFrame] | None = None

    def prepare(self) -> Replay:
        return self

    def _nodes(self) -> tuple[DataFrame, DataFrame]:
        """What blocks are formed from, and (node keys, weight) of each node with pairs."""
        if self._weighed is None and self.join.d > 1:
            both = settled(decompose.grouped(self.join))
            self._weighed = both, settled(decompose.merged(both)[0].groupBy(*decompose.keys_of(both)).agg(F.sum("weight").alias("weight")))
        elif self._weighed is None:
            boxes = [ranked(x.select("l0", "u0", "id"), ["l0", "id"]).select(F.lit(n).alias("side"), F.expr(f"rank div {1 << self.RUN}").alias("node"), "rank", "id", "l0", "u0") for n, x in enumerate((self.join.r, self.join.s))]
            both = settled(boxes[0].unionAll(boxes[1]))
            weighed = [self._spans(both, n).join(both.where(F.col("side") == n).select("node", "id"), "id").groupBy(F.lit(n).alias("side"), "node").agg(F.sum(F.col("hi") - F.col("lo")).alias("weight")) for n in (0, 1)]
            self._weighed = both, settled(weighed[0].unionAll(weighed[1]))
        return self._weighed

    def _spans(self, both: DataFrame, side: int, touched: DataFrame | None = None) -> DataFrame:
        """On one axis: (id, lo, hi, u) of a side's anchors, all or those of the touched nodes."""
        own = both.where(F.col("side") == side)
        own = own if touched is None else own.join(touched, ["side", "node"], "left_semi")
        return decompose.rank_intervals(own, both.where(F.col("side") == 1 - side), 0, side == 0)

    def keys(self) -> list[str]:
        return ["side", "node"] if self.join.d == 1 else decompose.keys_of(self._nodes()[0])

    def _count(self) -> int:
        return int(decompose.exact_total(self._nodes()[1]).first()["w"])

    def _dealt(self, drawn: DataFrame, w: int) -> DataFrame:
        """(pos, node keys, g): the node of each draw, and its place among the node's pairs."""
        return settled(picked(drawn, self._nodes()[1], self.keys(), w).select("pos", *self.keys(), F.col("offset").alias("g")))

    def quotas(self, t: int, query_id: int = 0) -> DataFrame:
        """(level, node keys, weight, quota): the draws of each node and, level by level, of all nodes whose last key begins with the same digits.

        A multinomial split of t by weight down a binary tree over the nodes; quotas of a level add up to t, as W's do to W.
        """
        w, keys = self.count(), self.keys()
        drawn = self._dealt(draws(self.spark, self.domain(), t, w, query_id), w) if t and w else self._nodes()[1].limit(0).withColumn("g", F.lit(0))
        own = drawn.groupBy(*keys).agg(F.count("*").alias("quota"))
        leaf = self._nodes()[1].join(own, keys, "left").select(*keys, "weight", F.coalesce("quota", F.lit(0)).alias("quota"))
        top = int(leaf.agg(F.max(keys[-1])).first()[0] or 0).bit_length()
        levels = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")
        up = leaf.select(levels, *keys[:-1], F.col(keys[-1]).alias("key"), "weight", "quota").withColumn(keys[-1], F.call_function("shiftright", "key", F.col("level")))
        return up.groupBy("level", *keys).agg(F.sum("weight").alias("weight"), F.sum("quota").alias("quota"))

    def _sample(self, drawn: DataFrame, w: int) -> DataFrame:
        both, _ = self._nodes()
        keys, dealt = self.keys(), self._dealt(drawn, w)
        touched = dealt.select(*keys).distinct()
        if self.join.d == 1:
            anchors = [self._spans(both, n, touched).join(both.where(F.col("side") == n), "id").select("side", "node", F.lit(n).alias("anchor_side"), F.col("id").alias("anchor_id"), "lo", "hi", (F.col("hi") - F.col("lo")).alias("weight"), F.col("rank").alias("nth")) for n in (0, 1)]
            blocks, lists, order = settled(anchors[0].unionAll(anchors[1])), both, ["anchor_side", "nth"]
        else:
            blocks, lists = decompose.merged(settled(both.join(touched, keys, "left_semi")), store=True)
            order = ["anchor_side", "anchor_id"]
        left = segmented(blocks, keys, order, {"first": F.col("weight")}, hot_groups(blocks, keys))
        fields = ["anchor_side", "anchor_id", "lo", "hi", "weight", "first"]
        # a node's pairs are met by its draws in one order of place: the last block that begins at or before a draw covers it
        a = left.select(*keys, F.col("first").alias("x"), F.lit(0).alias("tie"), F.lit(None).cast("bigint").alias("pos"), F.struct(*fields).alias("block"))
        b = dealt.select(*keys, F.col("g").alias("x"), F.lit(1).alias("tie"), "pos", F.lit(None).cast(left.select(*fields).schema.simpleString()).alias("block"))
        over = Window.partitionBy(*keys).orderBy("x", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = a.unionAll(b).withColumn("block", F.last("block", ignorenulls=True).over(over)).where("pos is not null")
        found = found.select("pos", *keys, "block.*", (F.col("x") - F.col("block.first")).alias("offset"))
        return _resolved(found, lists)


class _Owned(_Anchored):
    """Draws pick an owner by its number of pairs, then the k-th of its partners; where partners of all drawn owners are many, they are never listed.

    An owner's pairs lie in the groups of the decomposition where it has a block, whose partners are a run of ranks, and
    where it is a member of others' blocks: its partner there is the k-th of the anchors that begin at or before it and end
    after it, by upper end, which a rank/select table over the ends finds. Both take a few rows for each draw.
    """

    sweep = False
    _made: tuple[DataFrame, DataFrame, DataFrame] | None = None

    def _parts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Blocks, lists and the entries of owners."""
        if self._made is None:
            blocks, lists = decompose.atoms(self.join, store=True)
            self._made = blocks, lists, settled(decompose.entries(blocks, lists, self.sweep))
        return self._made

    def _weigh(self) -> DataFrame:
        if self.join.d == 1:
            return self._parts()[2].groupBy("side", "owner_id").agg(F.sum("weight").alias("weight"))
        return self._owners()

    def _owners(self) -> DataFrame:
        raise NotImplementedError

    def prepare(self) -> _Owned:
        self.weights  # noqa: B018
        return self

    def _sample(self, drawn: DataFrame, w: int) -> DataFrame:
        found, few = self._found(drawn, w)
        if few:
            return self._listed(found)
        blocks, lists, entries = self._parts()
        keys, found = decompose.keys_of(blocks), found.drop("weight")
        mine = entries.join(found.select("side", "owner_id").distinct(), ["side", "owner_id"], "left_semi")
        by = Window.partitionBy("side", "owner_id").orderBy("own", *keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        mine = mine.withColumn("from", F.sum("weight").over(by) - F.col("weight"))  # a row per group of the owner: O(log^(d-1))
        met = found.join(mine, ["side", "owner_id"]).where((F.col("place") >= F.col("from")) & (F.col("place") < F.col("from") + F.col("weight")))
        met = settled(met.select("pos", *keys, "side", "owner_id", "own", "lo", "x", (F.col("place") - F.col("from")).alias("k")))

        in_block = met.where("own = 0").select("pos", *keys, (1 - F.col("side")).alias("side"), "owner_id", (F.col("lo") + F.col("k")).alias("rank")).join(lists, [*keys, "side", "rank"])
        in_block = in_block.select("pos", (1 - F.col("side")).alias("side"), "owner_id", F.col("id").alias("other"))
        group = [*keys, "member"]
        asked = met.where("own = 1").withColumnRenamed("side", "member")
        others = blocks.where(F.col("anchor_side") != decompose.owner_of(blocks, self.sweep)).select(*keys, (1 - F.col("anchor_side")).alias("member"), "lo", "u", F.col("anchor_id").alias("other"))
        others = settled(others.join(asked.select(*group).distinct(), group, "left_semi"))
        n = others.count()
        if not n:
            return _pairs(in_block)
        pos = ranked(others.select(*group, "lo", "other"), [*group, "lo", "other"], "pos", n=n).select(*group, "other", "pos")
        val = ranked(others.select(*group, "u", "other"), [*group, "u", "other"], "val", n=n).select(*group, "other", "val")
        ends = settled(pos.join(val, [*group, "other"]))
        at = lambda c, name: counts_at(others.select(*group, F.col(c).alias("at")), asked.select(*group, "pos", F.col("lo" if c == "lo" else "x").alias("at"), F.lit(True).alias("inclusive")), "at", name, by=group).select("pos", name)
        # anchors that end at or before a member also begin before it, so they are the first values among those that have begun
        table = asked.select("pos", F.col("member").alias("side"), "owner_id", "k").join(at("lo", "begun"), "pos").join(at("u", "ended"), "pos")
        chosen = Levels(ends).kth(table.select("pos", "side", "owner_id", F.lit(0).cast("bigint").alias("first"), F.col("begun").alias("last"), (F.col("k") + F.col("ended")).alias("k")), name="val")
        return _pairs(in_block.unionAll(chosen.join(ends.select("val", "other"), "val").select("pos", "side", "owner_id", "other")))


class Sweep(_Owned):
    """The owner is the box that starts later on axis 0."""

    kind, sweep = "sweep", True

    def _owner(self) -> Column:
        return owner_side()

    def _owners(self) -> DataFrame:
        return weights(self.join).withColumnRenamed("id", "owner_id")


class Lifted(_Owned):
    """The owner is the R box."""

    kind = "lifted"

    def _owner(self) -> Column:
        return F.lit(0)

    def _owners(self) -> DataFrame:
        return weighed(self.join.s, self.join.r, [overlap(k) for k in range(self.join.d)]).select(F.lit(0).alias("side"), F.col("id").alias("owner_id"), "weight")


def make_sampler(kind: str, join: BoxJoin, seed: str = "0" * 64) -> Sampler:
    """A sampler of one of KINDS; the seed is 64 hex digits."""
    if len(seed) != 64 or not all(c in "0123456789abcdef" for c in seed):
        raise ValueError("a seed is 64 hex digits")
    return {c.kind: c for c in (Compiled, Replay, Sweep, Lifted)}[kind](join, seed)
