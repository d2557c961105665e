"""N-gram Jaccard join: a MinHash LSH forest proposes, exact Jaccard of word shingles decides."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, arrow_batches, components, given, groups_of, order_of, stored, table, text_key
from .text import mixed, runs, word_hashes

#: Words of a shingle, least similarity, trees of the forest, minima of a signature in each tree, recall aimed at.
SHINGLE, THRESHOLD, TREES, LONGEST, RECALL = 5, 0.8, 20, 12, 0.999
#: Classes and bytes of text of a block in a comparison; columns of its incidence matrix; width of the bins in which links are counted.
BLOCK, BLOCK_BYTES, COLUMNS, BIN = 512, 4 << 20, 4096, 0.02
_WORDS = regex.compile(WORD)
_ROW = ["id", "none", "key"]


def found_chance(similarity: float, length: int, trees: int = TREES) -> float:
    """The probability that two sets of that similarity share a prefix of that length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def estimated_recall(bins: list[int], length: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    """Share of links found so far, from the numbers of links in bins of similarity upwards from the threshold.

    Each one that was found stands for 1 / probability of its being found (Horvitz and Thompson), at its bin's lower end.
    One more in each bin makes few links poor evidence, so that prefixes go on being shortened.
    """
    whole = sum((n + 1) / found_chance(threshold + BIN * i, length, trees) for i, n in enumerate(bins))
    return sum(bins) / whole


def enough(bins: list[int], length: int, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> bool:
    """Whether prefixes needn't be shortened further: the recall is reached over all links, and in each bin that has any, however few."""
    each = all(found_chance(threshold + BIN * i, length, trees) >= recall for i, n in enumerate(bins) if n)
    return each and estimated_recall(bins, length, threshold, trees) >= recall


def lengths_for(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, longest: int = LONGEST) -> tuple[int, ...]:
    """Lengths of prefixes from `longest` on, each a third shorter, down to the longest that finds links at the threshold with `recall`."""
    last = next((n for n in range(longest, 0, -1) if found_chance(threshold, n, trees) >= recall), None)
    if last is None:
        raise ValueError(f"{trees} trees find links of {threshold} with less than {recall}: more trees are needed")
    out = [longest]
    while out[-1] > last:
        out.append(max(last, out[-1] - max(1, out[-1] // 3)))
    return tuple(out)


def shingle_sets(texts: list[str | None], k: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, text after text (repeats included), and their number per text; texts of 1 to k-1 words have one, the whole text."""
    h, n = word_hashes(texts, lane)
    start = np.cumsum(n) - n
    grams = runs(h, k)
    count = np.maximum(n - k + 1, (n > 0).astype(np.int64))
    out = np.empty(count.sum(), np.uint64)
    at = np.cumsum(count) - count
    long = n >= k
    inner = np.repeat(np.where(long, start - at, 0), count) + np.arange(len(out))
    of_long = np.repeat(long, count)
    out[of_long] = grams[inner[of_long]]
    for i in np.flatnonzero((n > 0) & ~long):
        x = np.uint64(n[i])
        for w in h[start[i] : start[i] + n[i]]:
            x = np.uint64((int(x) * 0x9FB21C651E98DF25 + int(w)) & (1 << 64) - 1)
        out[at[i]] = mixed(np.array([x]))[0]
    return out, count


def _minima(shingles: np.ndarray, at: np.ndarray, trees: int, length: int) -> np.ndarray:
    """16 bits of each minimum hash: rows of trees * length numbers, for sets that begin at `at`."""
    factor = mixed(np.arange(1, trees * length + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.empty((trees * length, len(at)), ">u2")
    for j, f in enumerate(factor):
        out[j] = mixed(np.minimum.reduceat(shingles * f, at)) >> np.uint64(48)
    return np.ascontiguousarray(out.T)


def _sketch(batches: Iterator[pa.RecordBatch], k: int, trees: int, longest: int, shortest: int) -> Iterator[pa.RecordBatch]:
    """node: 128 bits of the set of shingles (null for none); keys: its shortest prefix in each tree, as a number."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        shingles, count = shingle_sets(texts, k)
        second, _ = shingle_sets(texts, k, lane=1)
        some = np.flatnonzero(count)
        at = (np.cumsum(count) - count)[some]
        node, keys = [None] * len(count), [None] * len(count)
        if len(some):
            factor = mixed(np.arange(1, trees * longest + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
            prefix = np.empty((trees, len(some)), np.uint64)
            for t in range(trees):
                x = np.full(len(some), t + 1, np.uint64)
                for j in range(shortest):
                    low = mixed(np.minimum.reduceat(shingles * factor[t * longest + j], at)) >> np.uint64(48)
                    x = mixed(x * np.uint64(0xA24BAED4963EE407) + low)
                prefix[t] = x
            for row, i, a in zip(np.ascontiguousarray(prefix.T).view(np.int64), some.tolist(), at.tolist()):
                own, first = np.unique(shingles[a : a + count[i]], return_index=True)
                node[i] = hashlib.blake2b(own.tobytes() + second[a + first].tobytes(), digest_size=16).digest()
                keys[i] = row
        yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], [*_ROW, "node", "keys"])


def _signed(batches: Iterator[pa.RecordBatch], k: int, trees: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Adds the whole signature: `longest` minima in each tree, of two bytes each."""
    for batch in batches:
        shingles, count = shingle_sets(batch.column("text").to_pylist(), k)
        signature = _minima(shingles, np.cumsum(count) - count, trees, longest)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in signature], pa.binary())], [*batch.schema.names, "signature"])


def _exact_shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle), each pair once: runs of k words are numbered by the words themselves, no hash stands for them. Shorter texts are filled up."""
    numbers: dict[str, int] = {}
    flat, size = [], []
    for t in texts:
        w = [numbers.setdefault(x, len(numbers) + 1) for x in _WORDS.findall(t)]
        w += [0] * (k - len(w))
        flat += w
        size.append(len(w))
    word, size = np.array(flat, np.int64), np.array(size)
    gram = word
    for j in range(1, k):
        gram = np.unique(gram[:-1] * (len(numbers) + 1) + word[j:], return_inverse=True)[1]
    row = np.repeat(np.arange(len(size)), size)
    inside = row[: len(gram)] == row[k - 1 :]
    many = int(gram.max()) + 1
    row, gram = np.divmod(np.unique(row[: len(gram)][inside] * many + gram[inside]), many)
    return row, gram


def _overlaps(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sizes of all intersections of n sets, from the incidence matrix of values that two sets or more hold."""
    out = np.zeros((n, n), np.float32)
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    shared = np.bincount(value)[value] > 1 if len(value) else np.zeros(0, bool)
    row, value = row[shared], value[shared]
    if not len(value):
        return out
    value = np.cumsum(np.append(True, value[1:] != value[:-1])) - 1
    cuts = np.searchsorted(value, np.arange(0, value[-1] + COLUMNS + 1, COLUMNS))
    for c, (a, b) in enumerate(zip(cuts, cuts[1:])):
        x = np.zeros((n, min(COLUMNS, int(value[-1]) + 1 - c * COLUMNS)), np.float32)
        x[row[a:b], value[a:b] - c * COLUMNS] = 1
        out += x @ x.T
    return out


def _meet(lists: pa.ListArray, below: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of lists of numbers share one (of those below a row's own number, if given)."""
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    value = lists.flatten().to_numpy()
    if below is not None:
        row, value = row[value < below[row]], value[value < below[row]]
    return _overlaps(row, np.unique(value, return_inverse=True)[1], len(lists)) > 0


def _verify(batches: Iterator[pa.RecordBatch], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links within one block of a bucket, or between two: for each class their number and its component's smallest node there; for each batch the bins of their similarities, in a row of no class."""
    held, bins = [], np.zeros(_bins(threshold), np.int64)
    for group in groups_of(batches, "pair"):
        group = group.combine_chunks()
        node = group.column("node").to_pylist()
        copies, block, key = (group.column(c).to_numpy() for c in ("copies", "block", "key"))
        row, shingle = _exact_shingles(group.column("text").to_pylist(), k)
        n = np.bincount(row, minlength=len(node))
        both = _overlaps(row, shingle, len(node))
        similarity = both / (n[:, None] + n[None, :] - both)
        link = (similarity >= threshold) & (key[:, None] == key[None, :])
        np.fill_diagonal(link, False)
        if group.column("apart")[0].as_py():
            link &= block[:, None] != block[None, :]
        if not link.any():
            continue
        link &= ~_meet(group.column("keys").combine_chunks(), key)  # a pair counts in the first bucket that it shares
        link &= ~_meet(group.column("earlier").combine_chunks())  # and at the longest prefix that it shares
        i, j = np.nonzero(link)
        if not len(i):
            continue
        links = np.bincount(i, copies[j], len(node)).astype(np.int64)
        np.add.at(bins, np.minimum((similarity[i, j] - threshold + 1e-9) / BIN, len(bins) - 1).astype(np.int64), copies[j])
        order = np.array(sorted(range(len(node)), key=node.__getitem__))
        root = np.empty(len(node), np.int64)
        root[order] = np.arange(len(node))
        while True:
            was = root.copy()
            np.minimum.at(root, i, root[j])
            if (root == was).all():
                break
        for p in np.unique(i).tolist():
            held.append((node[p], node[order[root[p]]], links[p], None))
        if len(held) > 20_000:
            yield _linked([*held, (None, None, None, bins)])
            held, bins = [], np.zeros_like(bins)
    if held:
        yield _linked([*held, (None, None, None, bins)])


def _bins(threshold: float) -> int:
    return round((1 - threshold) / BIN) + 1


def _linked(held: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), (pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())))], ["node", "root", "links", "bins"])


def _prefixes(trees: int, longest: int, length: int) -> Column:
    """The key of a signature's prefix of `length` minima in each tree."""
    return F.array(*[F.xxhash64(F.lit(t), F.substring("signature", 2 * longest * t + 1, 2 * length)) for t in range(trees)])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, levels: tuple[int, ...] | None = None, recall: float = RECALL) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, text_key (128 bits of its SHA-256), class_id, n_links, component_id, kept.

    Documents link if the sets of their runs of `shingle` words have a Jaccard similarity of `threshold` or more; a text
    of fewer words has one shingle, itself; texts without words (or null) link with nothing. A class holds the documents
    of one set of shingles, by smallest doc_id; n_links counts other documents, copies included; component_id is the
    smallest doc_id reachable by links. One row of each component is kept, that of its smallest doc_id (of rows that
    repeat it, the one of least text_key; equal rows are all kept or all dropped). A null doc_id orders last and stays
    null. An empty table gives no row; other columns are not read, whatever their names. A very long text is held whole
    by one task, with its shingles; blocks of texts that are compared are bounded in number and in bytes, but for one text.

    One pass makes the shortest prefixes; classes that share none have no candidate. The others' signatures, the longest
    of `levels` minima per tree, are written as sorted arrays of (tree, signature, class), in which a prefix is a range.
    Prefixes are matched from the longest to the shortest: at each length, ranges that hold more than one longer prefix
    have new pairs, and these alone are verified, word by word, each in one range. The similarities found say how many
    links are still missing; once `recall` is reached over all links and for those of each similarity met, prefixes are
    shortened no more (enough). The lengths follow from the threshold (lengths_for); a recall above 1 matches all. Large ranges are cut into blocks that meet in pairs, so a task holds two blocks, and only counts and one row per linked class leave
    it. No link below the threshold is ever made; one at the threshold is missed with probability 0.0004 at length 5.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    levels = lengths_for(threshold, trees, min(recall, RECALL)) if levels is None else levels
    if recall <= 1 and found_chance(threshold, levels[-1], trees) < recall:
        raise ValueError(f"prefixes of {levels[-1]} find links of {threshold} with less than {recall}")
    longest, shortest = levels[0], levels[-1]
    rows = docs.select(*order_of(F.col("doc_id")), text_key(F.col("text")).alias("key"), "text")
    sketch = functools.partial(_sketch, k=shingle, trees=trees, longest=longest, shortest=shortest)
    sketched = stored(rows.mapInArrow(sketch, "id long, none boolean, key binary, node binary, keys array<long>"), "sketches")

    classes = stored(
        sketched.where("node is not null").groupBy("node").agg(F.min(F.struct(*_ROW)).alias("first"), F.count("*").alias("copies"), F.any_value("keys").alias("keys"))
        .select("node", "first.*", "copies", "keys"), "classes",
    )
    placed = classes.select("node", F.explode("keys").alias("prefix"))
    company = placed.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix")
    wanted = placed.join(company, "prefix").select("node").distinct()
    wanted = classes.join(wanted, "node").select("node", "copies", *_ROW)
    texts = rows.join(wanted, _ROW).dropDuplicates(_ROW).select("node", "copies", "text")
    members = stored(texts.mapInArrow(functools.partial(_signed, k=shingle, trees=trees, longest=longest), "node binary, copies long, text string, signature binary"), "members")
    entries = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("signature", 2 * longest * t + 1, 2 * longest).alias("minima")) for t in range(trees)]))
    forest = members.select("node", F.length("text").cast("long").alias("bytes"), entries.alias("e")).select("e.*", "node", "bytes")
    forest = stored(forest.repartitionByRange("tree", "minima", "node").sortWithinPartitions("tree", "minima", "node"), "forest")

    links, before = None, None
    for length in levels:
        new = _new_links(members, forest, shingle, threshold, trees, longest, length, before)
        links = new if links is None else links.unionAll(new)
        before = length
        bins = [n or 0 for n in links.where("node is null").agg(*[F.sum(F.col("bins")[i]) for i in range(_bins(threshold))]).first()]
        if enough(bins, length, threshold, trees, recall):
            break

    links = links.where("node is not null")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = (
        classes.select("node", F.struct(*_ROW).alias("first"), "copies").join(counted, "node", "left").join(joined, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least = found.groupBy("component").agg(F.min("first").alias("least"))
    found = found.join(least, "component").select("node", "first", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sketched.drop("keys").join(found, "node", "left").withColumn("own", F.struct(*_ROW))
    one = lambda name: F.coalesce(name, "own")
    return out.select(
        given(F.col("id"), F.col("none")).alias("doc_id"), F.col("key").alias("text_key"), given(one("first")["id"], one("first")["none"]).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), given(one("least")["id"], one("least")["none"]).alias("component_id"), (one("least") == F.col("own")).alias("kept"),
    )


def _new_links(members: DataFrame, forest: DataFrame, shingle: int, threshold: float, trees: int, longest: int, length: int, before: int | None) -> DataFrame:
    """(node, root, links, bins), and rows of bins alone: the links of pairs whose longest common prefix in any tree has `length` minima or more, but fewer than `before`."""
    at = forest.withColumn("prefix", F.xxhash64("tree", F.substring("minima", 1, 2 * length)))
    child = F.col("node") if before is None else F.substring("minima", 1, 2 * before)
    ranges = at.groupBy("prefix").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min(child).alias("low"), F.max(child).alias("high"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y"),
    ).where("low < high")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    ranges = ranges.groupBy("n", "bytes", "x", "y").agg(F.min("prefix").alias("prefix")).select("prefix", blocks.alias("blocks"))  # those of equal members once
    shared = at.join(ranges, "prefix").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.col("prefix").alias("key"), "blocks"))).alias("buckets"))
    earlier = F.array().cast("array<long>") if before is None else _prefixes(trees, longest, before)
    dealt = (
        members.join(shared, "node").select("node", "copies", "text", earlier.alias("earlier"), F.col("buckets.key").alias("keys"), F.explode("buckets").alias("b"))
        .select("node", "copies", "text", "earlier", "keys", "b.*")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("apart", F.col("with") != F.col("block"))
        .withColumn("pair", F.xxhash64("key", F.least("with", "block"), F.greatest("with", "block")))
    )
    together = dealt.select("pair", "key", "block", "apart", "node", "copies", "keys", "earlier", "text").repartition("pair").sortWithinPartitions("pair", "apart")
    verify = functools.partial(_verify, k=shingle, threshold=threshold)
    return stored(together.mapInArrow(verify, "node binary, root binary, links long, bins array<long>"), "links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


QUERIES, SQL = {"op9_ngram_jaccard_join": query}, {}
