"""Suffix-array dedup: longest-previous-factor arrays, from previous and next smaller positions in suffix order."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, given, groups_of, order_of, stored, table, text_key
from .text import mixed

#: Bytes of a repeated string; bytes of the grams that say which strings may be equal.
LENGTH, GRAM = 200, 32
#: Bytes of a suffix array. A group of contexts of more bytes is cut into ranges of so many starts, then of so many.
ARRAY, RANGES = 1 << 20, (16, 1)
#: Bytes of a text that are hashed together.
SEGMENT = 512 << 10
_FACTOR = 0x9E3779B97F4A7C15 | 5
_ROW = ["id", "none", "tk"]


def _grams(b: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive bytes, k a power of two: hashes of halves are joined."""
    h, factor, size = b.astype(np.uint64) + np.uint64(1), _FACTOR, 1
    while size < k:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor, size = factor * factor & (1 << 64) - 1, 2 * size
    return mixed(h)


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    size = 1
    while 2 * size <= w:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return np.minimum(key[: len(key) - (w - size)], key[w - size :]) if w > size else key


def anchors(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text, first start, last start, anchor, g): consecutive strings of `length` bytes that have the same anchor.

    A string's anchor is the place of its least gram, the leftmost of equals, and g that gram's hash: equal strings have
    equal g at equal offsets. Texts are taken together up to SEGMENT bytes, longer ones in parts that overlap.
    """
    wide = length - gram + 1
    held: list[tuple[int, int, bytes]] = []
    size = 0
    pieces = ((i, at, t[at : at + SEGMENT + length - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - length + 1), SEGMENT))
    for piece in (*pieces, None):
        if held and (piece is None or size + len(piece[2]) > SEGMENT):
            b = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
            if len(b) >= length:
                g = _grams(b, gram)
                n = len(b) - length + 1
                low = np.uint64((1 << 23) - 1)
                at = (_least(g & ~low | np.arange(len(g), dtype=np.uint64), wide) & low).astype(np.int64)[:n]
                which = np.repeat(np.arange(len(held)), [len(x) for _, _, x in held])
                inside = which[:n] == which[length - 1 :]
                change = np.append(True, (at[1:] != at[:-1]) | (which[1:n] != which[: n - 1]) | (inside[1:] != inside[:-1]))
                first = np.flatnonzero(change)
                last = np.append(first[1:], n) - 1
                first, last = first[inside[first]], last[inside[first]]
                piece_of = which[first]
                base = np.cumsum([0, *[len(x) for _, _, x in held]])[piece_of] - np.array([x for _, x, _ in held])[piece_of]
                yield np.array([x for x, _, _ in held])[piece_of], first - base, last - base, at[first] - base, g[at[first]].view(np.int64)
            held, size = [], 0
        if piece is not None:
            held.append(piece)
            size += len(piece[2])


def suffix_order(b: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in the order of their suffixes' first `depth` bytes or more (a power of two), and ranks by 8, 16, 32 ... bytes.

    Prefix doubling: positions that a prefix already tells apart keep their rank, others are sorted by the rank that
    follows. The end of the array is below any byte.
    """
    n = len(b)
    packed = np.ndarray(n, ">u8", b.tobytes() + bytes(8), strides=(1,)).astype(np.uint64)
    order = np.argsort(packed, kind=None if depth > 8 else "stable")  # only longer prefixes tell the array's end from zeros
    packed = packed[order]
    change = np.append(True, packed[1:] != packed[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    open_ = np.flatnonzero(~(change & np.append(change[1:], True)))
    size, ranks = 8, [rank]
    while size < depth:
        if len(open_):
            p = order[open_]
            follow = np.where(p + size < n, rank[np.minimum(p + size, n - 1)] + 1, 0)
            key = rank[p] << 32 | follow
            sub = np.argsort(key)
            p, key = p[sub], key[sub]
            order[open_] = p
            change = np.append(True, key[1:] != key[:-1])
            rank = rank.copy()
            rank[p] = np.maximum.accumulate(np.where(change, open_, 0))
            open_ = open_[~(change & np.append(change[1:], True))]
        size *= 2
        ranks.append(rank)
    return order, ranks


def common_prefix(b: np.ndarray, i: np.ndarray, j: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of suffixes i and j, up to what the ranks tell: halving steps by rank, then byte by byte."""
    i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    n = len(ranks[0])
    for k in range(len(ranks) - 1, -1, -1):
        size = 8 << k
        fits = (i + size <= n) & (j + size <= n)
        same = fits & (ranks[k][np.minimum(i, n - 1)] == ranks[k][np.minimum(j, n - 1)])
        out += np.where(same, size, 0)
        i, j = i + np.where(same, size, 0), j + np.where(same, size, 0)
    same = np.ones(len(i), bool)
    for k in range(7):
        same &= (i + k < n) & (j + k < n)
        same &= b[np.minimum(i + k, n - 1)] == b[np.minimum(j + k, n - 1)]
        out += same
    return out


def smaller_before(p: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left of each value, -1 for none: halving steps over minima of 2^k values."""
    n = len(p)
    tables = [p]
    while 2 << len(tables) - 1 <= n:
        t, s = tables[-1], 1 << len(tables) - 1
        tables.append(np.append(np.full(s, -1, p.dtype), np.minimum(t[s:], t[:-s])) if s < n else t)
    at = np.arange(n) - 1
    for k in range(len(tables) - 1, -1, -1):
        fits = at - (1 << k) + 1 >= 0
        skip = fits & (tables[k][np.maximum(at, 0)] > p)
        at = np.where(skip, at - (1 << k), at)
    while len(bad := np.flatnonzero((at >= 0) & (p[np.maximum(at, 0)] > p))):
        at[bad] -= 1
    return at


def previous_factors(b: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of `starts` (ascending): the longest factor that starts at an earlier one, and at a later one, up to about 2 * length.

    The longest previous factor is the longer of the common prefixes with the previous and the next suffix in order
    whose position is smaller; with larger positions in place of smaller ones, it is the longest next factor. A start
    that shares its first bytes, as many as the ranks tell up to `length`, with no other has no factor of `length`: its are given as 0.
    """
    depth = 8
    while depth < length:
        depth *= 2
    order, ranks = suffix_order(b, depth)
    chosen = np.zeros(len(b), bool)
    chosen[starts] = True
    if length >= 8:
        told = ranks[(length >> 3).bit_length() - 1]
        chosen &= (np.bincount(told, chosen, len(b)) > 1)[told]
    order = order[chosen[order]]
    out = []
    for sign in (1, -1):
        p = sign * order
        left = smaller_before(p)
        right = len(p) - 1 - smaller_before(p[::-1])[::-1]
        best = np.zeros(len(p), np.int64)
        for at, none in ((left, left < 0), (right, right >= len(p))):
            near = order[np.clip(at, 0, len(p) - 1)]
            best = np.maximum(best, np.where(none, 0, common_prefix(b, order, near, ranks)))
        whole = np.zeros(len(b), np.int64)
        whole[order] = best
        out.append(whole[starts])
    return out[0], out[1]


def _fingerprints(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (g, tk, more, again): a gram, a text it anchors, the batch's other such texts, and whether it does so twice in one text.

    A text of more than SEGMENT bytes comes in parts: a gram that anchored one of its earlier parts is met again.
    """
    for batch in batches:
        tk, raws = batch.column("tk").to_numpy(), batch.column("raw").to_pylist()
        parted, met = -1, set()
        for text, _, _, _, g in anchors(raws, length, gram):
            t = tk[text]
            before = np.zeros(len(g), bool)
            for i in np.unique(text[[0, -1]]).tolist() if len(text) else []:  # only the first and the last text can go on in another part
                if len(raws[i]) - length + 1 > SEGMENT:
                    if i != parted:
                        parted, met = i, set()
                    own = text == i
                    before[own] = [x in met for x in g[own].tolist()]
                    met.update(g[own].tolist())
            order = np.lexsort((t, g))
            g, t = g[order], t[order]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)])
            many = np.diff(np.append(first, len(g)))
            same = np.append(False, (g[1:] == g[:-1]) & (t[1:] == t[:-1]))[: len(g)] | before[order]
            again = np.add.reduceat(same, first) > 0 if len(first) else np.zeros(0, bool)
            more = [None] * len(first)
            for i in np.flatnonzero(many > 1).tolist():
                more[i] = np.unique(t[first[i] + 1 : first[i] + many[i]])
            yield pa.RecordBatch.from_arrays([pa.array(g[first]), pa.array(t[first]), pa.array(more, pa.list_(pa.int64())), pa.array(again)], ["g", "tk", "more", "again"])


def _contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The strings that have a shared anchor, as contexts: bytes from the first string's start to the last one's end; each once in a text, with all its starts."""
    for batch in batches:
        raws = batch.column("raw").to_pylist()
        shared = batch.column("gs")
        ids, none, tk = (batch.column(c).to_pylist() for c in _ROW)
        held, size = [], 0
        sets = [x.values.to_numpy() for x in shared]
        rows: dict[tuple, list] = {}
        done = 0
        for text, first, last, at, g in anchors(raws, length, gram):
            cut = np.searchsorted(text, np.arange(len(raws) + 1))
            for i in np.unique(text).tolist():
                if i != done:
                    held += rows.values()
                    rows, done = {}, i
                some = np.arange(cut[i], cut[i + 1])
                some = some[np.isin(g[some], sets[i])]
                for a, z, p, gram_hash in zip(first[some].tolist(), last[some].tolist(), at[some].tolist(), g[some].tolist()):
                    body = raws[i][a : z + length]
                    if (row := rows.get(body)) is not None:
                        row[6].append(a)
                        continue
                    rows[body] = [gram_hash, *_digest(body), ids[i], none[i], tk[i], [a], z - a + 1, p - a, body]
                    size += len(body) + 64
                if size > 4 << 20:
                    held += rows.values()
                    yield _batch(held)
                    held, rows, size = [], {}, 0
        held += rows.values()
        if held:
            yield _batch(held)


_LONG = pa.int64()
_CONTEXT = pa.schema(
    [("g", _LONG), ("c1", _LONG), ("c2", _LONG), ("id", _LONG), ("none", pa.bool_()), ("tk", _LONG), ("starts", pa.list_(_LONG)), ("strings", _LONG), ("anchor", _LONG), ("body", pa.binary())]
)
_PIECE = pa.schema([("c1", _LONG), ("c2", _LONG), ("base", _LONG), ("g", _LONG), ("p1", _LONG), ("p2", _LONG), ("strings", _LONG), ("anchor", _LONG), ("body", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema = _CONTEXT) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def _digest(body: bytes) -> tuple[int, int]:
    key = hashlib.blake2b(body, digest_size=16).digest()
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def _pieces(batches: Iterator[pa.RecordBatch], length: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Contexts of a large group, cut into pieces of up to `wide` strings that start at given distances before the anchor.

    Equal strings start at equal distances, and all strings of a range of distances share the bytes from the latest start
    to the earliest end. So a piece's new group is that range with those bytes: pieces of other groups hold no equal string.
    """
    for batch in batches:
        rows = []
        for g, c1, c2, n, anchor, body in zip(*(batch.column(c).to_pylist() for c in ("g", "c1", "c2", "strings", "anchor", "body"))):
            for r in range((anchor - n + 1) // wide, anchor // wide + 1):
                late, early = anchor - r * wide, anchor - (r + 1) * wide + 1  # the latest and earliest start of the range
                low, high = max(0, early), min(n - 1, late)
                piece, core = body[low : high + length], body[late : early + length]
                rows.append((c1, c2, low, _digest(f"{g} {r} ".encode() + core)[0], *_digest(piece), high - low + 1, anchor - low, piece))
                if len(rows) == 4096:
                    yield _batch(rows, _PIECE)
                    rows = []
        if rows:
            yield _batch(rows, _PIECE)


def _ranges(starts: np.ndarray) -> np.ndarray:
    """(first, last) of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return np.stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]], 1) if len(starts) else np.zeros((0, 2), np.int64)


def _factors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Groups of contexts (sorted by g) to rows (c1, c2, first, last): runs of strings in a context that occur in the group again."""

    def solved(groups: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(groups)
        bodies = t.column("body").to_pylist()
        size = np.array([len(x) for x in bodies])
        base = np.cumsum(size) - size
        n = t.column("strings").to_numpy()
        owner = np.repeat(np.arange(len(n)), n)
        starts = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + base[owner]
        before, after = previous_factors(np.frombuffer(b"".join(bodies), np.uint8), starts, length)
        again = (np.maximum(before, after) >= length) & (starts + length <= base[owner] + size[owner])
        runs = _ranges((starts + owner * length)[again])  # a step between contexts, so that no run crosses them
        own = np.searchsorted(base + np.arange(len(n)) * length, runs[:, 0], side="right") - 1
        off = runs - (base + np.arange(len(n)) * length)[own][:, None]
        c1, c2 = t.column("c1").to_numpy(), t.column("c2").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(c1[own]), pa.array(c2[own]), pa.array(off[:, 0]), pa.array(off[:, 1])], ["c1", "c2", "first", "last"])

    held, size = [], 0
    for group in groups_of(batches, "g"):
        held.append(group)
        size += group.column("body").nbytes
        if size >= ARRAY:
            yield solved(held)
            held, size = [], 0
    if held:
        yield solved(held)


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the bytes of the strings that start in its runs, and the number of spans removed."""
    for batch in batches:
        left, removed, spans = [], [], []
        for raw, contexts in zip(batch.column("raw").to_pylist(), batch.column("contexts")):
            found = []
            for starts, runs in zip(contexts.values.field("starts"), contexts.values.field("runs")):
                at = starts.values.to_numpy()[:, None]
                found.append(np.stack([(at + runs.values.field(x).to_numpy()).ravel() for x in ("first", "last")]))
            a, z = np.concatenate(found, axis=1)
            z = z + length
            order = np.argsort(a, kind="stable")
            a, z = a[order], np.maximum.accumulate(z[order])
            new = np.flatnonzero(np.append(True, a[1:] > z[:-1]))
            a, z = a[new], z[np.append(new[1:], len(z)) - 1]
            left.append(b"".join(raw[s:e] for s, e in zip([0, *z.tolist()], [*a.tolist(), len(raw)])))
            removed.append(int((z - a).sum()))
            spans.append(len(a))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _ROW), pa.array(left, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], [*_ROW, "left", "removed", "spans"])


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (what is left, null where nothing is removed).

    Removes each UTF-8 byte covered by a string of `length` bytes that also starts anywhere else, in the same text or
    another; overlaps count, and strings are judged on the input. Null texts are empty; matches never cross texts; rows
    that repeat a doc_id are texts of their own, so a row that occurs twice is removed. An empty table gives no row; other
    columns are not read, whatever their names. A text is held whole by the task that reads it; its anchors come in parts.

    Equal strings have an anchor of equal hash, so only strings whose anchor occurs twice are compared: their contexts
    (each distinct one once) meet by anchor in suffix arrays of bounded size, and a string occurs again where its longest
    previous or next factor reaches `length`. An anchor with more bytes of different contexts than ARRAY (a passage that
    very many texts share, at its ends) is cut into ranges of starts, each with the bytes that all its strings share, which
    are such groups again, down to ranges of one string. Texts that occur twice are removed whole; one of each stands for
    them. Texts and contexts are taken as equal by 128 bits of SHA-256 and BLAKE2b.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(*order_of(F.col("doc_id")), text_key(F.col("text")).alias("key"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw")).withColumn("tk", F.xxhash64("key"))
    sizes = stored(rows.select("id", "none", "key", "tk", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("whole")), "sizes")
    texts = sizes.groupBy("key").agg(F.min("id").alias("id"), F.min("none").alias("none"), F.count("*").alias("copies"))

    found = rows.select("tk", "raw").mapInArrow(functools.partial(_fingerprints, length=length, gram=gram), "g long, tk long, more array<long>, again boolean")
    # combined before the shuffle to one row, which meets all rows of its gram: a gram that very many texts have is split by AQE
    low, high = F.min(F.least("tk", F.array_min("more"))), F.max(F.greatest("tk", F.array_max("more")))
    spans = found.groupBy("g").agg(low.alias("lo"), high.alias("hi"), F.max("again").alias("twice")).where("lo < hi or twice").select("g")
    shared = found.join(spans, "g").select("g", F.explode(F.concat(F.array("tk"), F.coalesce("more", F.array().cast("array<long>")))).alias("tk"))
    wanted = shared.groupBy("tk").agg(F.collect_set("g").alias("gs")).join(texts.withColumn("tk", F.xxhash64("key")), "tk")
    wanted = stored(wanted.select(*_ROW, "gs"), "shared")

    one = rows.join(wanted, _ROW).dropDuplicates(_ROW).select(*_ROW, "raw", "gs")
    contexts = one.mapInArrow(
        functools.partial(_contexts, length=length, gram=gram), "g long, c1 long, c2 long, id long, none boolean, tk long, starts array<long>, strings long, anchor long, body binary"
    )
    contexts = stored(contexts, "contexts")
    context = ["g", "c1", "c2"]
    light = contexts.select(*context, "strings", F.size("starts").alias("k"), F.octet_length("body").cast("long").alias("len"))
    each = light.groupBy(*context).agg(F.sum("k").alias("n"), F.max("strings").alias("strings"), F.max("len").alias("len"))
    groups = each.groupBy("g").agg(F.count("*").alias("many"), F.sum("len").alias("bytes")).where("many > 1")
    wanted = each.join(groups, "g").select(*context, "bytes")
    distinct = contexts.groupBy(*context).agg(*[F.any_value(c).alias(c) for c in ("strings", "anchor", "body")])
    met = distinct.join(wanted, context)  # by the keys that distinct is dealt by, so that bodies stay where they are
    whole = each.where("n > 1").select("c1", "c2", F.lit(0).cast("long").alias("first"), (F.col("strings") - 1).alias("last"))
    again = _repeats(met, length, RANGES).unionAll(whole).groupBy("c1", "c2").agg(F.collect_set(F.struct("first", "last")).alias("runs"))

    placed = contexts.select("c1", "c2", *_ROW, "starts").join(again, ["c1", "c2"]).groupBy(*_ROW).agg(F.collect_list(F.struct("starts", "runs")).alias("contexts"))
    cut = rows.join(placed, _ROW).dropDuplicates(_ROW).select(*_ROW, "raw", "contexts")
    cut = cut.mapInArrow(functools.partial(_cut, length=length), "id long, none boolean, tk long, left binary, removed long, spans long").select(*_ROW, "removed", "spans", "left", F.sha2("left", 256).alias("rest"))

    of = sizes.join(texts.select("key", "copies"), "key").join(cut, _ROW, "left")
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return of.select(
        given(F.col("id"), F.col("none")).alias("doc_id"), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("rest", "whole")).alias("kept_sha256"), F.when(copy, F.lit(b"")).otherwise(F.col("left")).alias("kept"),
    )


def _repeats(met: DataFrame, length: int, ranges: tuple[int, ...]) -> DataFrame:
    """(c1, c2, first, last): runs of strings that occur again, from distinct contexts (g, c1, c2, strings, anchor, body) and the bytes of their groups."""
    arrays = met.where(F.col("bytes") <= ARRAY).select("g", "c1", "c2", "strings", "body").repartition("g").sortWithinPartitions("g")
    runs = arrays.mapInArrow(functools.partial(_factors, length=length), "c1 long, c2 long, first long, last long")
    if not ranges:  # pieces of one string: groups have but one body
        return runs
    large = met.where(F.col("bytes") > ARRAY).select("g", "c1", "c2", "strings", "anchor", "body")
    schema = "c1 long, c2 long, base long, g long, p1 long, p2 long, strings long, anchor long, body binary"
    pieces = stored(large.mapInArrow(functools.partial(_pieces, length=length, wide=ranges[0]), schema), "pieces")
    if pieces.isEmpty():
        return runs
    own = ["g", "p1", "p2"]
    distinct = pieces.groupBy(*own).agg(F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in ("strings", "anchor", "body")])
    groups = distinct.groupBy("g").agg(F.count("*").alias("many"), F.sum(F.octet_length("body")).cast("long").alias("bytes")).where("many > 1")
    inner = _repeats(distinct.join(groups, "g").select("g", F.col("p1").alias("c1"), F.col("p2").alias("c2"), "strings", "anchor", "body", "bytes"), length, ranges[1:])
    whole = distinct.where("n > 1").select("p1", "p2", F.lit(0).cast("long").alias("first"), (F.col("strings") - 1).alias("last"))
    inner = inner.select(F.col("c1").alias("p1"), F.col("c2").alias("p2"), "first", "last").unionAll(whole)
    met = pieces.select("c1", "c2", "base", "p1", "p2").join(inner, ["p1", "p2"])
    return runs.unionAll(met.select("c1", "c2", (F.col("base") + F.col("first")).alias("first"), (F.col("base") + F.col("last")).alias("last")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")


QUERIES, SQL = {"op10_suffix_factors": query}, {}
