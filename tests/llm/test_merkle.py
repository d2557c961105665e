"""The Merkle manifest against a loop over levels, at sizes that cut runs and merges everywhere."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F
from test_llm import arrow_docs, odd_docs, sql_rows

from boxloom.llm import merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fanout=3):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def proof(levels, i, fanout=3):
    out = []
    for level in levels[:-1]:
        a = i - i % fanout
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + fanout])))
        i //= fanout
    return out


def fold(x, steps):
    for before, after in steps:
        x = H(before, x, after)
    return x


def slow(rows):
    """The contract's columns, row by row, for (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for row in rows:
        odd = row[0] is None or zlib.crc32(str(row[0]).encode()) % 2
        now = row if odd else (*row[:4], row[4] and row[4].replace("\n", ""))
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, H(*map(field, row)), H(*map(field, now)), row[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[s])]) for s in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, now, doc_id) in enumerate(sorted(groups[s])):
            steps = proof(trees[k], i) + proof(top, k)
            got = fold(now, steps)
            out.append((doc_id, leaf, trees[k][-1][0], top[-1][0], H(*itertools.chain(*steps)), got, got == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_mountains_are_merged_to_the_tree(fanout):
    rnd = random.Random(fanout)
    for n in [*range(1, 40), 81, 82, 243, 500]:
        leaves = [bytes([n % 256, i % 256, i // 256]).ljust(32, b"x") for i in range(n)]
        levels = tree([x.hex() for x in leaves], fanout)
        width = merkle.widths(n, fanout)
        assert width == [len(x) for x in levels]
        pieces, at = [], 0
        while at < n:
            end = min(n, at + rnd.randrange(1, 9))
            pieces.append([(0, i, leaves[i]) for i in range(at, end)])
            at = end
        seen = {}
        while True:
            done = [merkle.climb(x, width, fanout) for x in pieces]
            for made, _ in done:
                assert not seen.keys() & {x[:2] for x in made}
                seen |= {x[:2]: x[2].hex() for x in made}
            pieces = [list(itertools.chain(*(left for _, left in done[i : i + 2]))) for i in range(0, len(done), 2)]
            if len(done) == 1:
                break
        assert seen == {(k, i): d for k, level in enumerate(levels) for i, d in enumerate(level) if k}
        assert done[0][1] == [(len(levels) - 1, 0, bytes.fromhex(levels[-1][0]))]


@pytest.mark.parametrize("sizes", [{}, {"piece": 2, "merged": 2}, {"piece": 7, "merged": 3}])
def test_manifest_of_odd_rows(spark, sizes):
    docs = odd_docs(spark)
    docs = docs.unionAll(docs.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("source", F.lit("hot"))).unionAll(docs.withColumn("source", F.lit("")))
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = merkle.manifest(docs, **sizes)
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("steps")).alias("s"), merkle.folded(F.col("leaf"), F.col("steps")).alias("f")).collect()
    want = [(x[0], *x[1:4], x[4], x[3]) for x in slow(rows)]
    assert sorted(((r[0], r[1], r[2], r[3], H(r[4]), r[5]) for r in got), key=str) == want
    assert merkle.manifest(docs.limit(0), **sizes).count() == 0


def test_node_records_are_every_node_once(spark):
    leaves = spark.range(200).select(F.when(F.col("id") < 150, "a").otherwise("b").alias("grp"), F.struct("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")).alias("row"))
    trees = merkle.Trees(leaves, [F.col("row.id")], piece=4, merged=3)
    got = sorted((r["grp"], r["level"], r["index"], r["digest"].hex()) for r in trees.nodes().collect())
    want = [(g, k, i, d) for g, ids in (("a", range(150)), ("b", range(150, 200))) for k, level in enumerate(tree([H(str(i)) for i in ids])) for i, d in enumerate(level) if k]
    assert got == want
    assert {r["grp"]: r["digest"].hex() for r in trees.roots().collect()} == {g: d for g, k, _, d in want if k == max(x[1] for x in want if x[0] == g)}


@pytest.mark.parametrize("n", [1, 60])
def test_query_against_loop_and_sql(spark, tmp_path, n):
    docs = odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).limit(n)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = merkle.query(spark, str(tmp_path))
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == slow(rows)
    assert sql_rows(f"select {', '.join(found.columns)} from ({merkle.ORACLE})", documents=arrow_docs(docs)) == sorted(map(repr, got))
    if n > 1:
        assert {r[-1] for r in got} == {True, False}
