"""Counter-based random integers: a draw is a function of (seed, domain, query, position), never of partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attempts of which the first below the bound counts; the chance that none does is below 2^-TRIES.
TRIES, EAGER = 64, 8


def bits60(*parts: Column) -> Column:
    """60 random bits from the SHA-256 of the parts joined by "|"."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("bigint")


def uniform_below(domain: str, pos: Column, bound: Column | int, query_id: int = 0) -> Column:
    """An unbiased integer in [0, bound): candidates are cut to the bits of bound - 1 and rejected at bound or above; no modulo of a range. A bound above 2^60 is an error."""
    bound = F.lit(bound).cast("bigint") if isinstance(bound, int) else bound.cast("bigint")
    bits = F.length(F.conv((bound - 1).cast("string"), 10, 2)).cast("int")
    mask = F.when(bound > 1, F.call_function("shiftright", F.lit((1 << 62) - 1).cast("bigint"), F.lit(62) - bits)).otherwise(F.lit(0).cast("bigint"))
    at = lambda k: bits60(F.lit(domain), F.lit(query_id), pos, k).bitwiseAND(mask)
    early = [F.when(at(F.lit(k)) < bound, at(F.lit(k))) for k in range(EAGER)]
    late = F.get(F.filter(F.transform(F.sequence(F.lit(EAGER), F.lit(TRIES - 1)), at), lambda x: x < bound), 0)
    early = [F.when(bound > F.lit(1 << 60), F.raise_error(F.lit("a bound above 2^60")).cast("bigint")), *early]
    none = F.raise_error(F.lit("no candidate below the bound, or an empty range")).cast("bigint")
    return F.coalesce(*early, late, none)


def mask_sql(bound: str) -> str:
    return f"case when {bound} > 1 then (1::bigint << length(ltrim(bin({bound} - 1), '0'))::int) - 1 else 0 end"


def uniform_sql(domain: str, pos: str, bound: str, query_id: int = 0) -> str:
    """The same draw in DuckDB's SQL."""
    candidate = f"(('0x' || substr(sha256('{domain}|{query_id}|' || {pos} || '|' || k), 1, 15))::bigint & ({mask_sql(bound)}))"
    return f"(list_filter(list_transform(range({TRIES}), lambda k: {candidate}), lambda x: x < {bound}))[1]"
