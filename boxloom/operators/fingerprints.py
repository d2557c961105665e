"""Fingerprints of collections: order-free hashes of rows, digest trees over keys, and what differs between two of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of 60 bits into which a row's SHA-256 is cut; bits of a key that a level of a digest tree takes away, so a node has at most 256 children.
LANES, BITS = 4, 8


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Hex SHA-256 of a row: for each column `-` if it is null, else the UTF-8 length of its text, `:` and the text (binary as hex)."""
    kinds = dict(df.dtypes)
    text = lambda c: F.hex(quoted(c)) if kinds[c] == "binary" else quoted(c).cast("string")
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns or df.columns]), 256)


def multiset(digest: Column) -> Column:
    """The sums of a digest's numbers over a group's rows: the same for the same rows in any order, repeats counted; sums of parts add up."""
    lane = lambda i: F.conv(F.substring(digest, 15 * i + 1, 15), 16, 10).cast("bigint").cast("decimal(28,0)")
    return F.concat_ws(",", *[F.sum(lane(i)).cast("string") for i in range(LANES)])


def fingerprints(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, rows, fingerprint): one aggregate with partial sums, so a hot group is as cheap as any. Without `by` an empty table has 0 and ''."""
    columns = [c for c in df.columns if c not in by] if columns is None else columns
    hashed = df.select(*[quoted(c) for c in by], row_digest(df, columns).alias("_row"))
    return hashed.groupBy(*[quoted(c) for c in by]).agg(F.count("*").alias("rows"), multiset(F.col("_row")).alias("fingerprint"))


def shared(collections: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """(collection, rows, fingerprint, same): whether collections agree on those columns with the first one, row for row; no pairs are formed.

    A collection without rows has 0 and ''.
    """
    tagged = [df.select(F.lit(name).alias("collection"), row_digest(df, columns).alias("_row")) for name, df in collections.items()]
    found = reduce(DataFrame.unionAll, tagged).groupBy("collection").agg(F.count("*").alias("rows"), multiset(F.col("_row")).alias("fingerprint"))
    names = found.sparkSession.createDataFrame([(n, i) for i, n in enumerate(collections)], "collection string, place int")  # a row per collection
    all_ = names.join(found, "collection", "left").select("collection", "place", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
    first = all_.where("place = 0").select(F.col("fingerprint").alias("first"))
    return all_.join(F.broadcast(first)).select("collection", "rows", "fingerprint", (F.col("fingerprint") == F.col("first")).alias("same"))  # first is one row


def leaves(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(node, rows, digest): a leaf per integer key, over all rows that repeat it; a null key has a leaf of its own."""
    found = fingerprints(df.withColumn("_key", quoted(key).cast("bigint")), columns or df.columns, ["_key"])
    return found.select(F.col("_key").alias("node"), "rows", F.sha2(F.concat(F.col("rows").cast("string"), F.lit(";"), "fingerprint"), 256).alias("digest"))


def tree(leaves_: DataFrame, levels: int) -> DataFrame:
    """(level, node, rows, digest) of levels 1 to `levels` over leaves: a node covers the keys that agree but for BITS * level low bits.

    Its digest is SHA-256 of `child:digest` in order of children (null first, as `-`), at most 256 of them and the null.
    Places depend on keys alone, so a row that comes, goes or changes alters one node a level.
    """
    at, out = leaves_, None
    for level in range(1, levels + 1):
        child = lambda x: F.concat(F.coalesce(x["node"].cast("string"), F.lit("-")), F.lit(":"), x["digest"])
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), child), ",")
        at = at.groupBy(F.shiftright("node", BITS).alias("above")).agg(F.sum("rows").alias("rows"), F.sha2(joined, 256).alias("digest")).withColumnRenamed("above", "node")
        here = at.select(F.lit(level).alias("level"), "node", "rows", "digest")
        out = here if out is None else out.unionAll(here)
    return out


def changed(before: DataFrame, after: DataFrame, on: Sequence[str] = ("node",)) -> DataFrame:
    """(on, change, rows_before, rows_after): leaves or nodes of two tables that aren't the same; change is added, removed or changed."""
    side = lambda df, name: df.select(*[F.col(c).alias(f"{name}_{c}") for c in (*on, "rows", "digest")])
    both = side(before, "b").join(side(after, "a"), reduce(lambda x, c: x & F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")), on, F.lit(True)), "full")
    change = F.when(F.col("b_digest").isNull(), "added").when(F.col("a_digest").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("b_digest").eqNullSafe(F.col("a_digest"))).select(*[F.coalesce(f"b_{c}", f"a_{c}").alias(c) for c in on], change.alias("change"), F.col("b_rows").alias("rows_before"), F.col("a_rows").alias("rows_after"))
