"""Substring dedup: a log-structured index of window fingerprints; sorted runs are merge-joined with each new batch, verified, compacted."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LAST_ID, WORD, arrow_batches, given, later, order_of, packed, remove, scratch, stored, table, text_key, unpacked, words
from .text import runs, word_hashes

#: Words of a window; words of the run that stands for a window in the index; batches of a whole table; runs of a tier before they are merged.
WINDOW, RUN, BATCHES, RUNS = 13, 4, 3, 1
#: A fingerprint that so many texts share or fewer has so few rows for each of its windows; those of more are split.
FEW = 256
#: What tells rows apart: the id and 64 bits of the text's key.
ROW = ["id", "none", "tk"]
_WORDS = regex.compile(WORD)


def anchors(h: np.ndarray, n: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, fingerprint) of each window within a text.

    The fingerprint is the least hash (leftmost first) of the runs of `run` words in the window, so equal windows have
    equal fingerprints, and neighbours mostly share one.
    """
    grams = runs(h, run)
    text = np.repeat(np.arange(len(n)), n)
    count = len(h) - window + 1
    if count <= 0:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    least = grams[:count].copy()
    for j in range(1, window - run + 1):
        np.minimum(least, grams[j : j + count], out=least)
    inside = np.flatnonzero(text[:count] == text[window - 1 :])
    return text[inside], inside, least[inside].view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch], window: int, run: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (g, tk, more): a fingerprint, a text that has it, and the batch's other texts that do."""
    for batch in batches:
        tk = batch.column("tk").to_numpy()
        h, n = word_hashes(batch.column("text").to_pylist())
        text, _, g = anchors(h, n, window, run)
        if not len(g):
            continue
        change = np.append(True, (g[1:] != g[:-1]) | (text[1:] != text[:-1]))
        g, t = g[change], tk[text[change]]
        order = np.lexsort((t, g))
        g, t = g[order], t[order]
        new = np.append(True, (g[1:] != g[:-1]) | (t[1:] != t[:-1]))
        g, t = g[new], t[new]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        many = np.diff(np.append(first, len(g)))
        more = [None] * len(first)
        for i in np.flatnonzero(many > 1).tolist():
            more[i] = t[first[i] + 1 : first[i] + many[i]]
        for s in range(0, len(first), 50_000):
            at = first[s : s + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(g[at]), pa.array(t[at]), pa.array(more[s : s + 50_000], pa.list_(pa.int64()))], ["g", "tk", "more"])


#: With these Spark takes a bucket's one file as sorted and aggregates it in that order; a compaction reads by buckets too.
_MERGE = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.execution.replaceHashWithSortAgg": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


@contextlib.contextmanager
def _settings(spark: SparkSession, given: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for what is planned and written within, and no longer."""
    old = {k: spark.conf.get(k) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


class FingerprintIndex:
    """Sorted immutable runs (g, tk, more) of historical window fingerprints, as bucketed tables below a folder, with a manifest.

    Every run is dealt by g into the same buckets, one sorted file each, so that a new batch's run meets itself and each
    older run in merge joins that neither move nor sort a row of either. Runs are only added. Once a tier has more than
    `most` runs they are merged, bucket by bucket, into one run of the next tier, so that a row is written again once for
    each tier, of which there are log(batches). A compaction writes its run, then a manifest that names it, then deletes
    the merged ones, so a job that fails leaves a whole index. The bucket count is the session's number of shuffle
    partitions when the index begins. An index outlives the session: open() finds it by its folder.
    Spark needs a catalog entry to know of buckets, so an open index has a database of its own, which close() drops.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, run: int = RUN, most: int = RUNS, buckets: int | None = None):
        self.spark, self.window, self.run, self.most = spark, window, run, most
        self.path = path or scratch(spark, "index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.version = 0
        self.database = f"fingerprints_{uuid.uuid4().hex}"
        spark.sql(f"create database {self.database} location '{self.path}/catalog'")

    @classmethod
    def open(cls, spark: SparkSession, path: str, most: int = RUNS) -> FingerprintIndex:
        """The index that was written to `path`."""
        manifest = spark.read.parquet(f"{path}/manifest")
        last = manifest.where(F.col("version") == manifest.agg(F.max("version")).first()[0]).first()
        index = cls(spark, path, last["window"], last["run"], most, last["buckets"])
        index.version, index.runs = last["version"], list(last["runs"])
        for name in index.runs:
            clustered = f"clustered by (g) sorted by (g) into {index.buckets} buckets location '{path}/{name}'"
            spark.sql(f"create table {index.database}.{name} (g bigint, tk bigint, more array<bigint>) using parquet {clustered}")
        return index

    def __enter__(self) -> FingerprintIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")

    def _put(self, rows: DataFrame, tier: int = 0) -> str:
        name = f"run_{tier}_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "g").sortBy("g").option("path", f"{self.path}/{name}").saveAsTable(f"{self.database}.{name}")
        return name

    def _record(self) -> None:
        self.version += 1
        row = [(self.runs, self.buckets, self.window, self.run)]
        self.spark.createDataFrame(row, "runs array<string>, buckets int, window int, run int").coalesce(1).write.parquet(f"{self.path}/manifest/version={self.version}")

    def add(self, texts: DataFrame) -> DataFrame:
        """Indexes texts(tk, text) as a run. Returns (g, tk): the fingerprints that a text of the batch shares with another text, with both texts.

        Too many runs are compacted first. A fingerprint that very many texts have is one row per Arrow batch, and meets
        one row that has its least and greatest text, so no task gathers its rows. What is found is written before
        anything else happens to the index.
        """
        self.compact()
        with _settings(self.spark, _MERGE):
            return self._add(texts)

    def _add(self, texts: DataFrame) -> DataFrame:
        fingerprints = functools.partial(_fingerprints, window=self.window, run=self.run)
        rows = texts.select("tk", "text").mapInArrow(fingerprints, "g long, tk long, more array<long>")
        own = self._put(rows.repartition(self.buckets, "g").sortWithinPartitions("g"))
        new = self._table(own)
        found = self.meeting(new, new).where("lo < hi").select("g", "tk", "more")
        for name in self.runs:
            old = self._table(name)
            for a, b in ((new, old), (old, new)):
                met = self.meeting(a, b).where((F.col("lo") < F.col("hi")) | (F.col("tk") != F.col("lo")) | F.col("more").isNotNull())
                found = found.unionAll(met.select("g", "tk", "more"))
        each = F.concat(F.array("tk"), F.coalesce("more", F.array().cast("array<long>")))
        found = stored(found.select("g", F.explode(each).alias("tk")), "found")
        self.runs.append(own)
        self._record()
        return found

    def meeting(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Rows of run a with (lo, hi), the least and greatest text that b has of their fingerprint: a merge join of sorted buckets."""
        spans = b.groupBy("g").agg(F.min("tk").alias("lo"), F.max(F.greatest("tk", F.array_max("more"))).alias("hi"))
        return a.hint("merge").join(spans, "g")

    def tiers(self) -> dict[int, list[str]]:
        """The runs of each tier."""
        out: dict[int, list[str]] = {}
        for name in self.runs:
            out.setdefault(int(name.split("_")[1]), []).append(name)
        return out

    def compact(self) -> None:
        """Merges the runs of each tier that has more than `most` into one of the next tier."""
        tier = 0
        while tier <= max(self.tiers(), default=-1):
            old = self.tiers().get(tier, [])
            if len(old) > self.most:
                with _settings(self.spark, _MERGE):
                    merged = self._put(self.merged(old), tier + 1)
                self.runs = [merged, *(x for x in self.runs if x not in old)]
                self._record()
                for name in old:
                    self.spark.sql(f"drop table {self.database}.{name}")
                    remove(self.spark, f"{self.path}/{name}")
            tier += 1

    def merged(self, runs: list[str]) -> DataFrame:
        """The rows of runs, each bucket's in one task: equal rows become one, and those of one fingerprint that name other texts stay beside each other."""
        by_row = [self._table(x).where("g is not null") for x in runs]  # a union of rows keeps the buckets, one of columnar batches doesn't
        rows = functools.reduce(DataFrame.unionAll, by_row)
        return rows.repartition(self.buckets, "g").distinct()

    def close(self) -> None:
        """Forgets the catalog entries; the folder stays."""
        self.spark.sql(f"drop database if exists {self.database} cascade")

    def drop(self) -> None:
        self.close()
        remove(self.spark, self.path)


def _windows(batches: Iterator[pa.RecordBatch], window: int, run: int) -> Iterator[pa.RecordBatch]:
    """The windows whose fingerprint another text shares, as 128-bit digests of their words: one row per window of a batch, with its first place and the others."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        h, n = word_hashes(texts)
        text, place, g = anchors(h, n, window, run)
        shared = batch.column("gs")
        own, row = shared.flatten().to_numpy(), np.repeat(np.arange(len(n)), shared.value_lengths().to_numpy())
        pick = np.zeros(len(g), bool)
        at, to = np.searchsorted(text, np.arange(len(n) + 1)), np.searchsorted(row, np.arange(len(n) + 1))
        for i in range(len(n)):
            pick[at[i] : at[i + 1]] = np.isin(g[at[i] : at[i + 1]], own[to[i] : to[i + 1]])
        text = text[pick]
        if not len(text):
            continue
        place = place[pick] - (np.cumsum(n) - n)[text]
        digests = []
        cut = np.searchsorted(text, np.arange(len(n) + 1))
        for i in np.unique(text).tolist():
            raw = " ".join(_WORDS.findall(texts[i])).encode("utf-8", "surrogatepass")
            gap = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
            p = place[cut[i] : cut[i + 1]]
            first, end = np.append(0, gap + 1)[p].tolist(), np.append(gap, len(raw))[p + window - 1].tolist()
            digests += [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(first, end)]
        a, b = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
        ids, none, tk = (batch.column(c).to_numpy(zero_copy_only=False)[text] for c in ROW)
        place = place.astype(np.int32)
        order = np.lexsort((b, a))
        new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(order)))
        some = np.flatnonzero(many > 1)
        others = order[~new]
        cuts = np.zeros(len(first) + 1, np.int64)
        cuts[some + 1] = many[some] - 1
        listed = pa.StructArray.from_arrays([pa.array(x[others]) for x in (ids, none, tk, place)], [*ROW, "place"])
        more = pa.ListArray.from_arrays(pa.array(np.cumsum(cuts), pa.int32()), listed, mask=pa.array(many == 1))
        back = np.argsort(order[first], kind="stable")  # in order of place, which compresses better
        lead = order[first][back]
        out = pa.RecordBatch.from_arrays([*(pa.array(x[lead]) for x in (a, b, ids, none, tk, place)), more.take(pa.array(back))], ["a", "b", *ROW, "place", "more"])
        for s in range(0, out.num_rows, 50_000):
            yield out.slice(s, 50_000)


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The text of what is left (the text itself where no window is removed) and the number of words removed, beside the other columns."""
    for batch in batches:
        left, removed = [], []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places")):
            if not places.is_valid:
                left.append(text)
                removed.append(0)
                continue
            w = _WORDS.findall(text)
            p = places.values.to_numpy()
            gone = np.zeros(len(w) + 1, int)
            np.add.at(gone, p, 1)
            np.add.at(gone, p + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            left.append(" ".join([x for x, y in zip(w, gone.tolist()) if not y]))
            removed.append(int(gone.sum()))
        rest = batch.drop_columns(["text", "places"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(left, pa.string()), pa.array(removed, pa.int64())], [*rest.schema.names, "left", "removed"])


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    rows = docs.select(*order_of(F.col("doc_id")), text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"), *more)
    return rows.withColumn("tk", F.xxhash64("key"))


def dedup(docs: DataFrame, window: int = WINDOW, run: int = RUN, batches: int = BATCHES, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, key (128 bits of the text's SHA-256), n_words, n_removed, kept_sha256.

    Removes each word covered by a window of `window` consecutive words that also starts in a document with a smaller
    doc_id; windows are judged on the input. What is left are the other words joined by one space. Null texts have no
    words; texts shorter than a window lose nothing; windows never cross documents. A null doc_id orders last; rows that
    repeat a doc_id never remove from each other. An empty table gives no row. Other columns are not read, whatever their
    names. A text is held as a whole, with its words, by the task that reads it.

    Batches in order of doc_id enter the index one after another. Only fingerprints that two different texts share are
    looked at again: the smallest document of each text has the words of those windows digested (128 bits of BLAKE2b), and
    windows that a smaller document also has are removed. Windows of a fingerprint that more than FEW texts share are
    combined before the shuffle, and the one row that is left meets theirs in a join that AQE can split, so one that very
    many texts share fills no task. Other documents of the same text lose all, as their windows all start in the smallest.

    With an `index` that has `history` (doc_id, text: all that was added before), docs are one more batch of it: they lose
    windows to documents of either, and only their rows are returned.
    """
    texts, sizes, least, places = _found(docs, window, run, batches, index=index, history=history)
    cut = texts.join(places, ROW).dropDuplicates(ROW).select(*ROW, "text", "places").mapInArrow(functools.partial(_cut, window=window), "id long, none boolean, tk long, left string, removed long")
    cut = cut.select(*ROW, "removed", F.sha2("left", 256).alias("rest"))
    of = sizes.where("new").join(least, "key").join(cut, ROW, "left")
    copy = _copy(window)
    return of.select(
        given(F.col("id"), F.col("none")).alias("doc_id"), "key", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("rest", "whole")).alias("kept_sha256"),
    )


def _copy(window: int) -> Column:
    """Whether a smaller document has the whole text, and the text has windows."""
    return later(F.col("id"), F.col("none"), F.col("least"), F.col("least_none")) & (F.col("n_words") >= window)


def remainders(docs: DataFrame, window: int = WINDOW, run: int = RUN, batches: int = BATCHES) -> DataFrame:
    """docs without what dedup() removes: the same columns, `text` where words are removed being the words left, joined by single spaces.

    Documents that lose all their words go; others keep their text as it is. `n_chars`, if there is one, follows the
    text. Texts are shuffled once: other columns meet them by the same keys before they are cut.
    """
    texts, sizes, least, places = _found(docs, window, run, batches, whole=False)
    others = [c for c in docs.columns if c != "text"]
    keyed = _keyed(docs, F.struct(packed(others).alias("others"), F.col("text").isNull().alias("none")).alias("row")).select(*ROW, "row")
    listed = keyed.groupBy(*ROW).agg(F.collect_list("row").alias("listed"))
    known = sizes.join(least, "key").where(~_copy(window)).select(*ROW, "n_words").distinct().join(listed, ROW)
    met = texts.join(places, ROW, "left").join(known, ROW).dropDuplicates(ROW).select("text", "places", "n_words", "listed")
    schema = met.drop("text", "places").schema.add("left", "string").add("removed", "long")
    cut = met.mapInArrow(functools.partial(_cut, window=window), schema).where("removed = 0 or removed < n_words").withColumn("row", F.explode("listed"))
    text = F.when(~F.col("row.none"), F.col("left"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    own = dict(zip(others, unpacked("row.others", others)))
    return cut.select(*[(new[c] if c in new else own[c]).alias(c) for c in docs.columns])


def _found(
    docs: DataFrame, window: int, run: int, batches: int, whole: bool = True, index: FingerprintIndex | None = None, history: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(texts, sizes, least, places): keyed texts, their numbers of words, the smallest id of each text, and the windows to remove of each of those."""
    spark = docs.sparkSession
    arrow_batches(spark)
    new = _keyed(docs, F.lit(True).alias("new"))
    rows = new if history is None else new.unionAll(_keyed(history, F.lit(False).alias("new")))
    w = words(F.col("text"))
    digest = [F.sha2(F.array_join(w, " "), 256).alias("whole")] if whole else []
    sizes = stored(rows.select("id", "none", "key", "tk", "new", F.size(w).cast("long").alias("n_words"), *digest), "sizes")
    least = sizes.groupBy("key").agg(F.min("id").alias("least"), F.min("none").alias("least_none"))

    own = FingerprintIndex(spark, window=window, run=run) if index is None else index
    try:
        if index is None and batches > 1:
            cuts = sizes.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01)
            bounds = [None, *sorted({min(int(x), LAST_ID - 1) for x in cuts}), None]
        else:
            bounds = [None, None]
        shared = None
        for low, high in zip(bounds, bounds[1:]):
            part = new.where((F.lit(True) if low is None else F.col("id") > low) & (F.lit(True) if high is None else F.col("id") <= high))
            found = own.add(part)
            shared = found if shared is None else shared.unionAll(found)
    finally:
        if index is None:
            own.drop()
    many = shared.groupBy("g").agg((F.count("*") > FEW).alias("many"))
    sets = [F.array_sort(F.collect_set(F.when(c, F.col("g")))).alias(name) for name, c in (("few", ~F.col("many")), ("many", F.col("many")))]
    wanted = shared.join(many, "g").groupBy("tk").agg(*sets).join(least.withColumn("tk", F.xxhash64("key")), "tk")
    wanted = stored(wanted.select(F.col("least").alias("id"), F.col("least_none").alias("none"), "tk", "few", "many"), "shared")

    texts = rows.select(*ROW, "text")  # in one form for all joins, so that texts are shuffled once
    asked = texts.join(wanted, ROW)
    place = "struct<id:long,none:boolean,tk:long,place:int>"

    def seen(which: str) -> DataFrame:
        some = asked.where(F.size(which) > 0).select(*ROW, "text", F.col(which).alias("gs"))
        return some.mapInArrow(functools.partial(_windows, window=window, run=run), f"a long, b long, id long, none boolean, tk long, place int, more array<{place}>")

    low, high = (lambda c, f=f, g=g: f(c, g(f"more.{c}")) for f, g in ((F.least, F.array_min), (F.greatest, F.array_max)))
    ends = {"lo": F.min(low("id")), "lo_none": F.min(low("none")), "hi": F.max(high("id")), "hi_none": F.max(high("none"))}
    apart = later(F.col("hi"), F.col("hi_none"), F.col("lo"), F.col("lo_none"))
    # windows of few texts are dealt once and meet in their group; those of many are combined before the shuffle to one row, which meets all of theirs
    by = Window.partitionBy("a", "b")
    few = seen("few").withColumns({c: x.over(by) for c, x in ends.items()}).where(apart)
    many = stored(seen("many"), "many")  # read twice, digested once
    spans = many.groupBy("a", "b").agg(*[x.alias(c) for c, x in ends.items()]).where(apart)
    met = few.unionByName(many.join(spans, ["a", "b"])).select("lo", "lo_none", *ROW, "place", "more")
    each = F.concat(F.array(F.struct(*ROW, "place")), F.coalesce("more", F.array().cast(f"array<{place}>")))
    met = met.select("lo", "lo_none", F.explode(each).alias("w")).where(later(F.col("w.id"), F.col("w.none"), F.col("lo"), F.col("lo_none")))
    places = met.select("w.*").groupBy(*ROW).agg(F.collect_set("place").alias("places"))
    return texts, sizes, least, places


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("key")


ORACLE = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from d where len(w) >= {WINDOW}),
x as (select doc_id, i, min(doc_id) over (partition by array_to_string(w[i : i + {WINDOW - 1}], ' ')) as least from s),
r as (select distinct doc_id, i + k as i from x, range({WINDOW}) as g(k) where least < doc_id),
g as (select doc_id, list(i) as gone from r group by doc_id),
k as (select d.doc_id, w, coalesce(gone, []) as gone from d left join g using (doc_id))
select doc_id, len(w)::bigint as n_words, len(gone)::bigint as n_removed,
       sha256(array_to_string(case when len(gone) = 0 then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end, ' ')) as kept_sha256
from k
"""
QUERIES, SQL = {"op5_substring_index": query}, {"op5_substring_index": ORACLE}
