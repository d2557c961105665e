"""Box relations: half-open axis-aligned boxes as flat columns id, l0.., u0.., and the predicates over them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDPOINTS = ("double", "bigint")


class BoxError(ValueError):
    """A relation or instance breaks the data model."""


def lowers(d: int) -> list[str]:
    return [f"l{j}" for j in range(d)]


def uppers(d: int) -> list[str]:
    return [f"u{j}" for j in range(d)]


def boxes(df: DataFrame, id: Column | str, lower: Sequence[Column | str], upper: Sequence[Column | str]) -> DataFrame:
    """A box relation: one id column and d lower and d upper endpoints, all double or all bigint."""
    if not lower or len(lower) != len(upper):
        raise BoxError("lower and upper need the same positive number of columns")
    col = lambda c: F.col(c) if isinstance(c, str) else c
    out = df.select(col(id).alias("id"), *[col(c).alias(f"l{j}") for j, c in enumerate(lower)], *[col(c).alias(f"u{j}") for j, c in enumerate(upper)])
    kinds = {t for name, t in out.dtypes if name != "id"}
    if len(kinds) != 1 or not kinds <= set(ENDPOINTS):
        raise BoxError(f"endpoints must be all double or all bigint, not {sorted(kinds)}")
    return out


def dimension(df: DataFrame) -> int:
    d = sum(c[0] == "l" and c[1:].isdigit() for c in df.columns)
    if not d or any(c not in df.columns for c in ("id", *lowers(d), *uppers(d))):
        raise BoxError(f"not a box relation: {df.columns}")
    return d


def nonempty(d: int, prefix: str = "") -> Column:
    """A box is empty if some lower endpoint isn't below its upper one."""
    return reduce(and_, [F.col(f"{prefix}l{j}") < F.col(f"{prefix}u{j}") for j in range(d)])


def overlaps(d: int, first: int = 0, r: str = "r_", s: str = "s_") -> Column:
    """Strict overlap of two non-empty half-open boxes on axes first..d-1; boxes that only touch don't overlap."""
    pairs = [(F.col(f"{r}l{j}") < F.col(f"{s}u{j}")) & (F.col(f"{s}l{j}") < F.col(f"{r}u{j}")) for j in range(first, d)]
    return reduce(and_, pairs, F.lit(True))


def closed_overlaps(d: int, r: str = "r_", s: str = "s_") -> Column:
    return reduce(and_, [(F.col(f"{r}l{j}") <= F.col(f"{s}u{j}")) & (F.col(f"{s}l{j}") <= F.col(f"{r}u{j}")) for j in range(d)])


def ownership(d: int, r: str = "r_", s: str = "s_") -> Column:
    """Bit j is set where R's lower endpoint is at or before S's: the 2^d disjoint classes of overlapping pairs."""
    return reduce(lambda a, b: a + b, [F.when(F.col(f"{r}l{j}") <= F.col(f"{s}l{j}"), 1 << j).otherwise(0) for j in range(d)]).cast("bigint")


def side(df: DataFrame, prefix: str) -> DataFrame:
    """The relation with all columns prefixed."""
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def finite(df: DataFrame) -> DataFrame:
    """Fails at run time on NaN and infinity, which would otherwise order above everything and join silently."""
    d, kinds = dimension(df), dict(df.dtypes)
    if kinds["l0"] != "double":
        return df
    odd = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf"))) | c.isNull()
    guard = lambda c: F.when(odd(F.col(c)), F.raise_error(F.concat(F.lit(f"{c} isn't finite in box "), F.col("id").cast("string"))).cast("double")).otherwise(F.col(c))
    return df.select("id", *[guard(c).alias(c) for c in (*lowers(d), *uppers(d))])


def strict(df: DataFrame, name: str = "relation") -> DataFrame:
    """What files hold: finite and non-empty boxes; fails at run time on any other."""
    d = dimension(df)
    empty = F.raise_error(F.concat(F.lit(f"{name} holds the empty box "), F.col("id").cast("string")))
    return finite(df).withColumn("id", F.when(nonempty(d), F.col("id")).otherwise(empty.cast(dict(df.dtypes)["id"])))


def repeated_ids(df: DataFrame) -> DataFrame:
    """(id, copies) of ids that a side has more than once: a valid side gives no row."""
    return df.groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_first, only_second): rows of one relation that the other lacks, repeats counted; equal collections give zeros."""
    n = lambda x, y, name: x.exceptAll(y).agg(F.count("*").alias(name))
    return n(a, b, "only_first").crossJoin(n(b, a, "only_second"))  # of one row each


def extent(df: DataFrame) -> DataFrame:
    """Number of boxes and the smallest and largest endpoint of each axis."""
    d = dimension(df)
    return df.agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in (*lowers(d), *uppers(d)) for name, f in (("min", F.min), ("max", F.max))])


def around(df: DataFrame, id: str, center: Sequence[str], radius: Sequence[int]) -> DataFrame:
    """Integer boxes with closed bounds center +- radius, as half-open [c - r, c + r + 1); an overflow is an error."""
    col = [F.col(c).cast("bigint") for c in center]
    return boxes(df, id, [c - F.lit(r).cast("bigint") for c, r in zip(col, radius)], [c + F.lit(r + 1).cast("bigint") for c, r in zip(col, radius)])


def middle(lo: Column, hi: Column) -> Column:
    """The integer center of closed integer bounds of an even width that isn't negative; others are an error."""
    width = hi - lo
    odd = (width < 0) | (width % 2 != 0)
    return F.when(odd, F.raise_error(F.lit("bounds without an integer center")).cast("bigint")).otherwise((lo + (width / 2).cast("bigint")).cast("bigint"))


def slab(df: DataFrame, id: str, x: tuple[str, str], y: tuple[str, str], z: str) -> DataFrame:
    """Boxes over x and y that are one unit thick at an integer z: [z, z + 1) as double."""
    level = F.col(z).cast("double")
    return boxes(df, id, [F.col(x[0]).cast("double"), F.col(y[0]).cast("double"), level], [F.col(x[1]).cast("double"), F.col(y[1]).cast("double"), level + 1.0])


@dataclass(frozen=True)
class BoxJoin:
    """Two box relations of one dimension and endpoint type; empty boxes are filtered, as they join with nothing."""

    r: DataFrame
    s: DataFrame

    def __post_init__(self):
        d = dimension(self.r)
        if d != dimension(self.s):
            raise BoxError("both sides need the same dimension")
        if dict(self.r.dtypes)["l0"] != dict(self.s.dtypes)["l0"]:
            raise BoxError("both sides need the same endpoint type")
        object.__setattr__(self, "d", d)

    def clean(self) -> BoxJoin:
        return BoxJoin(self.r.where(nonempty(self.d)), self.s.where(nonempty(self.d)))

    def any_touch(self) -> Column:
        """Pairs that meet only under closed comparison."""
        return closed_overlaps(self.d) & ~overlaps(self.d)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))
