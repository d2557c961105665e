"""Stable hashes: canonical JSON, tagged SHA-256 digests, 64-bit mixing; on the driver and as columns."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from collections.abc import Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the version named inside every hashed envelope.
VERSION = "anchor-canonical-json-v1"


def _plain(x: Any) -> Any:
    if isinstance(x, np.generic | np.ndarray):
        x = x.tolist()
    match x:
        case None | bool() | int():
            return x
        case float() if math.isfinite(x):
            return x + 0.0
        case str():
            return unicodedata.normalize("NFC", x)
        case Mapping():
            pairs = [(_plain(k), _plain(v)) for k, v in x.items()]
            if any(not isinstance(k, str) for k, _ in pairs) or len(dict(pairs)) != len(pairs):
                raise ValueError("keys must be strings that differ after normalization")
            return dict(pairs)
        case list() | tuple():
            return [_plain(v) for v in x]
    raise ValueError(f"not representable: {x!r}")


def canonical_json(x: Any) -> str:
    """JSON with sorted keys, no spaces, NFC strings, no negative zero; NaN and infinity are errors."""
    return json.dumps(_plain(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def stable_digest(tag: str, *fields: Any) -> bytes:
    return hashlib.sha256(canonical_json({"tag": tag, "fields": list(fields), "version": VERSION}).encode()).digest()


def stable_id(tag: str, *fields: Any, bits: int = 64) -> int:
    return int.from_bytes(stable_digest(tag, *fields)[: bits // 8], "big")


def canonical_integers(*cols: Column) -> Column:
    """Canonical JSON of an array of integers."""
    return F.concat(F.lit("["), F.concat_ws(",", *[c.cast("string") for c in cols]), F.lit("]"))


def stable_hex(tag: str, *fields: Column) -> Column:
    """Hex digest of a tagged envelope whose fields are given as canonical JSON; stays in the JVM. Hex order is byte order."""
    head, tail = '{"fields":[', f'],"tag":{canonical_json(tag)},"version":{canonical_json(VERSION)}}}'
    return F.sha2(F.concat(F.lit(head), F.concat_ws(",", *fields), F.lit(tail)), 256)


@F.pandas_udf(StringType())
def canonical_json_udf(values: pd.Series) -> pd.Series:
    """Canonical JSON of JSON texts; null stays null."""
    return values.map(lambda x: None if x is None else canonical_json(json.loads(x)))


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer over wrapping 64-bit integers (its constants are fixed values)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def point_priority(traj: Column, point: Column, tag: str) -> Column:
    """Keyed 64-bit priority of a trajectory point, as 16 hex digits, whose order is that of the unsigned number."""
    seed = np.uint64(int.from_bytes(stable_digest(tag)[:8], "little"))

    @F.pandas_udf(StringType())
    def priority(t: pd.Series, p: pd.Series) -> pd.Series:
        key = t.to_numpy(np.int64).view(np.uint64) ^ (p.to_numpy(np.int64).astype(np.uint64) << np.uint64(32)) ^ seed
        return pd.Series([f"{x:016x}" for x in splitmix(key).tolist()])

    return priority(traj, point)
