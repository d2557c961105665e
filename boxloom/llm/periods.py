"""Periodic runs of words: a harmonic grid of (period, place) pairs, whose common extensions prefix hashes find for all pairs at once."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import WORD, arrow_batches, table, words
from .text import mixed

#: A run has so many words at least, and so many periods.
LEAST, TIMES = 24, 3
#: Pairs of the grid that are extended together.
PAIRS = 1 << 18
_RUN = StructType().add("start", "long").add("length", "long").add("period", "long")
_PRIME, _WORD = np.uint64((1 << 31) - 1), re.compile(WORD)


class Hashes:
    """Prefix hashes of a sequence of codes. Equal stretches have equal hashes; attempt 0 works modulo 2^64, later ones modulo a prime in two lanes."""

    def __init__(self, codes: np.ndarray, attempt: int = 0):
        self.lanes = []
        for lane in range(2 if attempt else 1):
            h = mixed(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * attempt + lane + 1))
            factor = int(mixed(np.array([7919 * attempt + lane + 1], np.uint64))[0])
            if not attempt:
                power = np.full(len(codes) + 1, factor | 1, np.uint64)
                power[0] = 1
                power = np.multiply.accumulate(power)
                self.lanes.append((np.append(np.uint64(0), np.cumsum(h * power[:-1])), power))
                continue
            power, base = np.ones(1, np.uint64), factor % (int(_PRIME) - 2) + 2
            while len(power) <= len(codes):
                power = np.append(power, power * np.uint64(pow(base, len(power), int(_PRIME))) % _PRIME)
            power = power[: len(codes) + 1]
            self.lanes.append((np.append(np.uint64(0), np.cumsum(h % _PRIME * power[:-1] % _PRIME) % _PRIME), power))
        self.prime = bool(attempt)

    def equal(self, i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
        """Whether `size` codes from i and from j (j > i) hash alike."""
        out = np.ones(len(i), bool)
        for total, power in self.lanes:
            a, b = total[i + size] - total[i], total[j + size] - total[j]
            if self.prime:
                a, b = (a + _PRIME) % _PRIME, (b + _PRIME) % _PRIME
                out &= a * power[j - i] % _PRIME == b
            else:
                out &= a * power[j - i] == b
        return out

    def after(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common codes from i and j on, `most` of them, by a binary search of all pairs at once."""
        out = np.zeros(len(i), np.int64)
        for k in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            on = np.flatnonzero(out + (1 << k) <= most)
            on = on[self.equal(i[on] + out[on], j[on] + out[on], 1 << k)]
            out[on] += 1 << k
        return out

    def before(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common codes that end before i and j."""
        out = np.zeros(len(i), np.int64)
        for k in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            on = np.flatnonzero(out + (1 << k) <= most)
            on = on[self.equal(i[on] - out[on] - (1 << k), j[on] - out[on] - (1 << k), 1 << k)]
            out[on] += 1 << k
        return out


def _grid(n: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) in parts of about PAIRS. A run of period q has max(least - q, (times - 1) q) neighbouring places that match
    those q later, so places so far apart meet each run; there are about n / q of them, n log n for all periods."""
    periods = np.where(n >= least, n // times, 0)
    text = np.repeat(np.arange(len(n)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(least - q, (times - 1) * q)
    places = (n[text] - q) // step
    total = np.cumsum(places)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        c = places[at:end]
        k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + 1
        yield np.repeat(text[at:end], c), np.repeat(q[at:end], c), k * np.repeat(step[at:end], c) - 1
        at = end


def runs(codes: list[np.ndarray], least: int = LEAST, times: int = TIMES, attempt: int = 0) -> list[np.ndarray]:
    """For each sequence its runs as rows (start, length, period), by start and period.

    A run is a stretch with smallest period q and at least max(least, times * q) codes that no neighbour extends; times is 3
    or more. Hashes only propose: a run's codes are compared themselves, and a sequence where one fails is done again with
    other hashes.
    """
    n = np.array([len(x) for x in codes], np.int64)
    base = np.cumsum(n) - n
    flat = np.concatenate(codes) if len(codes) else np.zeros(0, np.int64)
    hashes = Hashes(flat, attempt)
    found = [np.zeros((0, 4), np.int64)]
    for text, q, place in _grid(n, least, times):
        i = base[text] + place
        on = np.flatnonzero(flat[i] == flat[i + q])
        text, q, i = text[on], q[on], i[on]
        after = hashes.after(i, i + q, base[text] + n[text] - i - q)
        before = hashes.before(i, i + q, i - base[text])
        on = np.flatnonzero(after + before >= np.maximum(least - q, (times - 1) * q))
        found.append(np.unique(np.stack([text[on], i[on] - before[on], i[on] + q[on] + after[on], q[on]], 1), axis=0))
    every = np.unique(np.concatenate(found), axis=0)
    # multiples of a period cover the same stretch; the rows are in order, so the first of equal stretches has the smallest
    every = every[np.flatnonzero(np.append(True, (every[1:, :3] != every[:-1, :3]).any(axis=1))[: len(every)])]
    cut = np.searchsorted(every[:, 0], np.arange(len(n) + 1))
    out = []
    for k in range(len(n)):
        own = every[cut[k] : cut[k + 1]]
        if all(np.array_equal(flat[a : z - q], flat[a + q : z]) for _, a, z, q in own.tolist()):
            own = np.stack([own[:, 1] - base[k], own[:, 2] - own[:, 1], own[:, 3]], 1)
            out.append(own[np.lexsort((own[:, 2], own[:, 0]))])
        else:
            out.append(runs([codes[k]], least, times, attempt + 1)[0])
    return out


def _collapse(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [_WORD.findall(t or "") for t in batch.column("_text").to_pylist()]
        code: dict[str, int] = {}
        found = runs([np.fromiter((code.setdefault(w, len(code)) for w in t), np.int64, len(t)) for t in texts], least, times)
        left = []
        for t, own in zip(texts, found):
            if len(own):
                kept = np.ones(len(t), bool)
                for a, size, q in own.tolist():
                    kept[a + q : a + size] = False
                t = [t[i] for i in np.flatnonzero(kept).tolist()]
            left.append(" ".join(t))
        ends = np.cumsum([0, *map(len, found)])
        flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([len(t) for t in texts], pa.int64()), lists, pa.array(left, pa.string())], ["row", "n_words", "runs", "collapsed"])


def collapse(docs: DataFrame, text: Column | str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, times: int = TIMES) -> DataFrame:
    """For each row of docs: row (a struct of the columns in `keep`), n_words, runs (start, length, period by start and period) and collapsed.

    collapsed has the words that no run holds beyond its first period, joined by single spaces. A null text has no words, no
    runs and an empty rest, as one without words; rows that repeat give the same twice; an empty table gives none; kept
    columns may have any name. Row by row in Arrow batches, no shuffle; a long text is held with its words by one task,
    its grid in parts of PAIRS, in time n log^2 n.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), (F.col(text) if isinstance(text, str) else text).alias("_text"))
    schema = rows.select(F.col("_row").alias("row")).schema.add("n_words", "long").add("runs", ArrayType(_RUN)).add("collapsed", "string")
    return rows.mapInArrow(functools.partial(_collapse, least=least, times=times), schema)


def densest(found: Column) -> Column:
    """The run of greatest length / period, by exact products; of equals the first by start, then period. Null without runs."""
    more = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]
    return F.aggregate(found, F.get(found, 0), lambda best, x: F.when(more(x, best), x).otherwise(best))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document by checksum is first made periodic from a word of its own on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    split = docs.withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text")))).withColumns({"n": F.size("w"), "g": F.expr("h div 10")})
    placed = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")).withColumn("p", (1 + F.expr("(n - a) div (3 + g % 8)")).cast("int"))
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    found = collapse(placed.withColumn("text", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text"))))
    best = found.select("row.doc_id", "runs", "collapsed", densest(F.col("runs")).alias("best"))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES, SQL = {"op13_periodic_runs": query}, {}
