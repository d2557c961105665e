"""A rank/select table: points in one order, cut by digits of their rank in another; batches of lookups descend it level by level by equi-joins.

On level L the points stand by the first L digits of their value, then by position: each node, a prefix of digits, is a run
of neighbouring places. Blocks of BLOCK places hold the next digits and, of each digit, how many stand before the block. So
what is below a value, or the k-th least value, among the first so many positions is found with one or two rows per level,
however many points lie in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import ROWS, ranked, running
from .storage import settled

#: Bits of a digit, and places of a block.
BITS, BLOCK = 4, 64
DIGITS = 1 << BITS
_LONG = "bigint"


def _shift(x: Column, by: int) -> Column:
    return F.call_function("shiftleft", x, F.lit(by))


def _count(digits: Column | str, g: Column) -> Column:
    return F.size(F.filter(digits, lambda x: x == g))


def _counts(before: str, head: Column, full: Column) -> Column:
    """How often each digit stands in the first places of a node."""
    return F.transform(before, lambda n, g: n - full + _count(head, g))


class Levels:
    """The table of points(pos, val): both are 0 .. n - 1, each once. It has n rows / BLOCK on each of log16 n levels."""

    def __init__(self, points: DataFrame, rows: int = ROWS):
        self.points = settled(points.select(F.col("pos").cast(_LONG), F.col("val").cast(_LONG)))
        self.n = self.points.count()
        self.height = max(1, -(-max(1, self.n - 1).bit_length() // BITS))
        level = F.explode(F.sequence(F.lit(0), F.lit(self.height - 1))).alias("level")
        each = self.points.select(level, "pos", "val")
        below = (BITS * (F.lit(self.height) - F.col("level"))).cast("int")
        each = each.select("level", F.call_function("shiftright", "val", below).alias("node"), "pos", F.call_function("shiftright", "val", below - BITS).bitwiseAND(DIGITS - 1).cast("tinyint").alias("digit"))
        place = F.col("place") - F.col("level") * F.lit(self.n)
        placed = ranked(each, ["level", "node", "pos"], "place", rows, self.n * self.height).select("level", place.alias("place"), "digit")
        block = F.expr(f"place div {BLOCK}").alias("block")
        listed = placed.groupBy("level", block).agg(F.sort_array(F.collect_list(F.struct("place", "digit"))).alias("x")).select("level", "block", F.col("x.digit").alias("digits"))
        sums = {f"d{g}": _count("digits", F.lit(g)).cast(_LONG) for g in range(DIGITS)}
        base = running(settled(listed), ["level", "block"], sums, rows, n=self.n * self.height // BLOCK + self.height)
        before = F.array(*[F.col(f"d{g}") - self._earlier(g) for g in range(DIGITS)])
        self.blocks = settled(base.select("level", "block", "digits", before.alias("before")))

    def _earlier(self, g: int) -> Column:
        """How often the digit stands on the levels above: what 0 .. n - 1 have."""
        total, out = 0, [0]
        for level in range(self.height - 1):
            unit = 1 << BITS * (self.height - level - 1)
            total += self.n // (unit * DIGITS) * unit + min(unit, max(0, self.n % (unit * DIGITS) - g * unit))
            out.append(total)
        return F.element_at(F.array(*[F.lit(x).cast(_LONG) for x in out]), F.col("level") + 1)

    def _at(self, level: int, name: str) -> DataFrame:
        """The blocks of a level, by the key of the lookup `name`."""
        own = self.blocks.where(F.col("level") == level)
        return own.select(F.col("block").alias(f"{name}_block"), F.col("digits").alias(f"{name}_digits"), F.col("before").alias(f"{name}_before"))

    def _look(self, asked: DataFrame, level: int, name: str) -> DataFrame:
        """asked with the block that holds the last of the first `name` places of its node; no block for none."""
        start = _shift(F.col("node"), BITS * (self.height - level))
        last = F.when(F.col(name) > 0, start + F.col(name) - 1)
        return asked.withColumn(f"{name}_last", last).withColumn(f"{name}_block", F.expr(f"{name}_last div {BLOCK}")).join(self._at(level, name), f"{name}_block", "left")

    def below(self, asked: DataFrame, first: str = "first", value: str = "value", name: str = "n") -> DataFrame:
        """Adds to asked(first, value, ..) how many of the first `first` positions have a value below `value`."""
        rest = asked.columns
        inner = (F.col(value) > 0) & (F.col(value) < self.n) & (F.col(first) > 0)
        done = F.when(F.col(value) >= self.n, F.col(first)).otherwise(F.lit(0)).cast(_LONG)
        now = asked.select(F.struct(*rest).alias("row"), F.when(inner, F.col(value)).otherwise(0).cast(_LONG).alias("v"), F.when(inner, F.col(first)).otherwise(0).cast(_LONG).alias("a"), F.lit(0).cast(_LONG).alias("node"), F.when(inner, 0).otherwise(done).cast(_LONG).alias("n"))
        for level in range(self.height):
            unit = BITS * (self.height - level - 1)
            met = self._look(now, level, "a").withColumn("g", F.call_function("shiftright", "v", F.lit(unit)).bitwiseAND(DIGITS - 1).cast("int"))
            head = F.slice("a_digits", 1, F.pmod("a_last", F.lit(BLOCK)).cast("int") + 1)
            full = _shift(F.col("node"), unit)  # what the nodes before have of each digit
            less = F.size(F.filter(head, lambda x: x < F.col("g"))) + F.aggregate(F.slice("a_before", 1, F.col("g")), F.lit(0).cast(_LONG), lambda s, x: s + x) - F.col("g") * full
            same = _count(head, F.col("g")) + F.get("a_before", F.col("g")) - full
            some = F.col("a") > 0
            now = met.select("row", "v", F.when(some, same).otherwise(0).cast(_LONG).alias("a"), (_shift(F.col("node"), BITS) + F.col("g")).alias("node"), (F.col("n") + F.when(some, less).otherwise(0)).alias("n"))
        return now.select("row.*", F.col("n").alias(name))

    def kth(self, asked: DataFrame, first: str = "first", last: str = "last", k: str = "k", name: str = "value") -> DataFrame:
        """Adds to asked(first, last, k, ..) the k-th least value, from 0, of positions first .. last - 1; k must be below their number."""
        now = asked.select(F.struct(*asked.columns).alias("row"), F.col(first).cast(_LONG).alias("a"), F.col(last).cast(_LONG).alias("b"), F.col(k).cast(_LONG).alias("k"), F.lit(0).cast(_LONG).alias("node"))
        for level in range(self.height):
            full = _shift(F.col("node"), BITS * (self.height - level - 1))
            met = self._look(self._look(now, level, "a"), level, "b")
            of = {}
            for x in "ab":
                head = F.slice(f"{x}_digits", 1, F.pmod(f"{x}_last", F.lit(BLOCK)).cast("int") + 1)
                of[x] = F.when(F.col(x) > 0, _counts(f"{x}_before", head, full)).otherwise(F.array_repeat(F.lit(0).cast(_LONG), DIGITS))
            counted = met.select("row", "k", "node", of["a"].alias("a"), of["b"].alias("b"))
            # the digit is the first with which more than k are counted
            start = F.struct(F.lit(0).alias("g"), F.col("k").alias("k"))
            step = lambda s, g: F.when((s["g"] == g) & (F.get("b", g) - F.get("a", g) <= s["k"]), F.struct((g + 1).alias("g"), (s["k"] - F.get("b", g) + F.get("a", g)).alias("k"))).otherwise(s)
            found = counted.withColumn("s", F.aggregate(F.sequence(F.lit(0), F.lit(DIGITS - 1)), start, step))
            now = found.select("row", F.get("a", F.col("s.g")).alias("a"), F.get("b", F.col("s.g")).alias("b"), F.col("s.k").alias("k"), (_shift(F.col("node"), BITS) + F.col("s.g")).alias("node"))
        return now.select("row.*", F.col("node").alias(name))
