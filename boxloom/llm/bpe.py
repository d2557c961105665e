"""Byte-level BPE: a segment tree over byte positions keeps the leftmost pair of least rank; a merge updates three leaves."""

from __future__ import annotations

import base64
import functools
import itertools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, packed, table, unpacked

VOCABULARY = "byte_bpe_50k.tiktoken"
#: No pair: more than any rank.
NONE = np.int32(2**31 - 1)
#: Matches up to this many bytes are merged many at a time; a task remembers the ids of so many different matches.
SHORT, REMEMBERED = 64, 100_000
#: Texts beyond this many characters are matched piece by piece, never as one list.
LONG_TEXT = 1 << 20


class Ranks:
    """The vocabulary: tokens by id, ids by bytes, and the rank of each pair of tokens whose bytes together are a token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        halves = ((a, b, i) for t, i in self.ids.items() for k in range(1, len(t)) if (a := self.ids.get(t[:k])) is not None and (b := self.ids.get(t[k:])) is not None)
        self.pair = {a << 32 | b: i for a, b, i in halves}
        self._keys = np.array(sorted(self.pair), np.int64)
        self._ranks = np.array([self.pair[k] for k in self._keys.tolist()], np.int32)
        self.known: dict[str, bytes] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NONE)


def merge_many(r: Ranks, pieces: list[bytes]) -> list[bytes]:
    """Ids (little-endian uint32) of pieces of 2 to SHORT bytes, whose trees are rows of one array."""
    n = np.array([len(p) for p in pieces])
    width = int(n.max())
    leaves = 1 << max(0, int(width - 2).bit_length())
    rows = np.arange(len(pieces))
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
    ids = r.of_byte[raw]
    col = np.arange(width)
    ids[col >= n[:, None]] = -1
    after = np.tile(col + 1, (len(pieces), 1))
    before = np.tile(col - 1, (len(pieces), 1))
    tree = np.full((len(pieces), 2 * leaves), NONE, np.int32)
    tree[:, leaves : leaves + width - 1] = np.where(col[1:] < n[:, None], r.rank_of(ids[:, :-1], ids[:, 1:]), NONE)
    for first in (leaves >> k for k in range(1, leaves.bit_length())):
        tree[:, first : 2 * first] = np.minimum(tree[:, 2 * first : 4 * first : 2], tree[:, 2 * first + 1 : 4 * first : 2])
    live = rows[tree[:, 1] < NONE]
    while len(live):
        best = tree[live, 1]
        node = np.ones(len(live), np.int64)
        while node[0] < leaves:
            node *= 2
            node += tree[live, node] != best  # the left child, unless only the right one has the least rank
        i = node - leaves
        j = after[live, i]
        k = after[live, j]
        h = before[live, i]
        ids[live, i] = best
        ids[live, j] = -1
        after[live, i] = k
        end = k >= n[live]
        kk = np.where(end, 0, k)
        inner = ~end
        before[live[inner], kk[inner]] = i[inner]
        start = h < 0
        hh = np.where(start, i, h)
        tree[live, leaves + np.minimum(j, leaves - 1)] = np.where(j < leaves, NONE, tree[live, 2 * leaves - 1])
        tree[live, leaves + i] = np.where(end, NONE, r.rank_of(best, ids[live, kk]))
        tree[live, leaves + hh] = np.where(start, tree[live, leaves + i], r.rank_of(ids[live, hh], best))
        at = [(leaves + x) >> 1 for x in (i, np.minimum(j, leaves - 1), hh)]
        while at[0][0] > 0:
            for x in at:
                tree[live, x] = np.minimum(tree[live, 2 * x], tree[live, 2 * x + 1])
            at = [x >> 1 for x in at]
        live = live[tree[live, 1] < NONE]
    flat, kept = ids.astype("<u4"), ids >= 0
    return [flat[x][kept[x]].tobytes() for x in rows]


def merge_one(r: Ranks, piece: bytes) -> bytes:
    """Ids of one long piece: the same tree in arrays, at most 32 bytes for each byte, in time n log n."""
    n, none = len(piece), int(NONE)
    first = r.of_byte[np.frombuffer(piece, np.uint8)]
    leaves = 1 << (n - 1).bit_length()
    whole = np.full(2 * leaves, NONE, np.int32)
    whole[leaves : leaves + n - 1] = r.rank_of(first[:-1], first[1:])
    for k in range(leaves.bit_length() - 2, -1, -1):
        whole[1 << k : 2 << k] = np.minimum(whole[2 << k : 4 << k : 2], whole[(2 << k) + 1 : 4 << k : 2])
    ids, tree = array("i", first.tobytes()), array("i", whole.tobytes())
    after, before, pair = array("i", range(1, n + 1)), array("i", range(-1, n - 1)), r.pair
    del first, whole

    def put(x: int, rank: int) -> None:
        x += leaves
        tree[x] = rank
        while x > 1:
            x >>= 1
            tree[x] = min(tree[2 * x], tree[2 * x + 1])

    while (best := tree[1]) < none:
        x = 1
        while x < leaves:
            x *= 2
            x += tree[x] != best
        i = x - leaves
        j, h = after[i], before[i]
        k = after[j]
        ids[i], ids[j], after[i] = best, -1, k
        put(j, none)
        if k < n:
            before[k] = i
        put(i, pair.get(best << 32 | ids[k], none) if k < n else none)
        if h >= 0:
            put(h, pair.get(ids[h] << 32 | best, none))
    found = np.frombuffer(ids, np.int32)
    return found[found >= 0].astype("<u4").tobytes()


def learn(r: Ranks, pieces: Iterable[str]) -> None:
    """Puts the ids of matches that aren't known yet into r.known."""
    new = [p for p in set(pieces) if p not in r.known]
    if len(r.known) + len(new) > REMEMBERED:
        r.known.clear()
        new = list(set(pieces))
    by: dict[int, list[tuple[str, bytes]]] = {}
    for p in new:
        raw = p.encode("utf-8", "surrogatepass")
        whole = r.ids.get(raw)
        if whole is not None:
            r.known[p] = whole.to_bytes(4, "little")
        elif len(raw) > SHORT:
            r.known[p] = merge_one(r, raw)
        else:
            by.setdefault(int(len(raw) - 2).bit_length(), []).append((p, raw))
    for some in by.values():
        for at in range(0, len(some), 4096):
            part = some[at : at + 4096]
            r.known.update(zip((p for p, _ in part), merge_many(r, [b for _, b in part])))


@functools.cache
def tokens(path: str) -> dict[int, bytes]:
    """Tokens by id, without what only merging needs."""
    with open(path, "rb") as lines:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}


@functools.cache
def ranks(path: str) -> Ranks:
    """Read once per Python worker."""
    return Ranks(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str, back: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (row, _text) to (row, ids), and `bytes`, what the ids stand for, if they are to be decoded too."""
    r, match = ranks(path), regex.compile(pattern)
    for batch in batches:
        texts = batch.column("_text").to_pylist()
        texts = ["" if t is None else t for t in texts]
        short = [match.findall(t) if len(t) <= LONG_TEXT else None for t in texts]
        learn(r, set(itertools.chain.from_iterable(x for x in short if x)))
        get, out = r.known.__getitem__, []
        whole = [b"".join(map(get, x)) if x is not None else None for x in short]
        for t, ids in zip(texts, whole):
            if ids is None:
                parts, found = [], (m.group() for m in match.finditer(t))
                while part := list(itertools.islice(found, 1 << 16)):
                    learn(r, part)
                    parts.append(b"".join(map(r.known.__getitem__, part)))
                ids = b"".join(parts)
            out.append(ids)
        del texts, short, whole
        columns = [pa.array(out, pa.binary())] + ([pa.array([decoded(r.tokens, x) for x in out], pa.binary())] if back else [])
        yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", "ids", "bytes"][: len(columns) + 1])
    r.known.clear()  # an idle worker keeps no matches


def decoded(token: dict[int, bytes], ids: bytes) -> bytes:
    """The bytes of ids, a part of them at a time."""
    found = np.frombuffer(ids, "<u4")
    return b"".join(b"".join(map(token.__getitem__, found[at : at + (1 << 16)].tolist())) for at in range(0, len(found), 1 << 16))


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    token = tokens(path)
    for batch in batches:
        out = [None if x is None else decoded(token, x) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary())], ["row", "bytes"])


def _coded(docs: DataFrame, keep: tuple[str, ...], text: str, vocabulary: str | None, pattern: str, back: bool) -> DataFrame:
    """(row, ids), and bytes if decoded too; row has the columns in `keep`."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(packed(keep).alias("row"), F.col(text).alias("_text"))
    schema = rows.drop("_text").schema.add("ids", "binary")
    schema = schema.add("bytes", "binary") if back else schema
    return rows.mapInArrow(functools.partial(_encode, path=vocabulary or public_tokenizers.path(VOCABULARY), pattern=pattern, back=back), schema)


def encode(docs: DataFrame, keep: tuple[str, ...] = (), text: str = "text", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The columns in `keep`, whatever their names, and `ids`: each whole text's token ids as little-endian uint32 in a binary column.

    Each match of `pattern` is merged by itself, without special tokens, as the tiktoken library would; a match that is a
    token itself needs no merging. `vocabulary` is the path of a rank file on every worker. A null text is an empty one,
    which has no ids; equal rows give equal results; an empty table gives none. Row by row in Arrow batches, no shuffle.
    A worker holds one batch, the vocabulary and REMEMBERED matches; texts over LONG_TEXT are taken in parts, a match of n
    bytes takes 32 n bytes while it is merged.
    """
    return _coded(docs, keep, text, vocabulary, pattern, False).select(*unpacked("row", keep), "ids")


def decode(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """df with `bytes`, what `ids` stand for, in place of `ids`; null stays null. An unknown id is an error."""
    path, others = vocabulary or public_tokenizers.path(VOCABULARY), [c for c in df.columns if c != "ids"]
    rows = df.select(packed(others).alias("row"), "ids")
    found = rows.mapInArrow(functools.partial(_decode, path=path), rows.select("row").schema.add("bytes", "binary"))
    return found.select(*unpacked("row", others), "bytes")


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def round_trip(docs: DataFrame, keep: tuple[str, ...] = (), ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (ids, if asked for, and `keep`) of docs(doc_id, text): encoded, then decoded again by the same worker.

    Kept columns may have any name, those of the result too, which stand first. Nulls, ties and long texts as for encode().
    """
    coded = _coded(docs, ("doc_id", *keep), "text", None, public_tokenizers.PATTERN, True)
    doc_id, *kept = unpacked("row", ("doc_id", *keep))
    return coded.select(
        doc_id, n_tokens(F.col("ids")).alias("n_tokens"), *(["ids"] if ids else []), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
        *kept,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES, SQL = {"op1_byte_bpe": query}, {}
