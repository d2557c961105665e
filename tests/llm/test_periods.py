"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from test_llm import WORD, odd_docs, order

from boxloom.llm import periods


def slow_runs(w, least=24, times=3):
    """All maximal stretches by definition: matching neighbours for each period, smallest period of equal stretches."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in found.items())


def thue_morse(n):
    w = [0]
    while len(w) < n:
        w += [1 - x for x in w]
    return w[:n]


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (1, 4)])
def test_runs_against_brute_force(least, times, monkeypatch):
    monkeypatch.setattr(periods, "PAIRS", 40)
    rnd = random.Random(least)
    for _ in range(60):
        texts = []
        for _ in range(rnd.randrange(1, 6)):
            w = []
            while len(w) < rnd.choice([0, 5, 30, 90, 200]):
                unit = [rnd.randrange(rnd.choice([1, 2, 4])) for _ in range(rnd.randrange(1, 20))]
                w += (unit * rnd.randrange(1, 9))[: rnd.randrange(1, 80)]
            texts.append(np.array(w, np.int64))
        assert [[tuple(r) for r in x.tolist()] for x in periods.runs(texts, least, times)] == [slow_runs(x.tolist(), least, times) for x in texts]
    assert periods.runs([]) == []


def test_words_that_collide_modulo_a_power_of_two():
    tm = thue_morse(2048)
    w, other = np.array(tm * 3 + [0, 1], np.int64), np.array(thue_morse(8192), np.int64)
    proposed = periods.Hashes(np.array(tm + [1 - x for x in tm]), 0)
    assert proposed.equal(np.array([0]), np.array([2048]), 2048)[0]  # so the words must be verified
    for x in (w, other):
        assert [tuple(r) for r in periods.runs([x])[0].tolist()] == slow_runs(x.tolist())
    assert not periods.Hashes(np.array(tm + [1 - x for x in tm]), 1).equal(np.array([0]), np.array([2048]), 2048)[0]


def test_one_word_over_and_over():
    assert periods.runs([np.zeros(50_000, np.int64)])[0].tolist() == [[0, 50_000, 1]]


def test_collapse_of_odd_texts(spark):
    docs = odd_docs(spark).withColumnRenamed("label", "x.y")
    rows = periods.collapse(docs, keep=("doc_id", "text", "x.y")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        w = WORD.findall(r["row"]["text"] or "")
        want = slow_runs(w)
        assert r["n_words"] == len(w) and [tuple(x) for x in r["runs"]] == want
        gone = {i for a, n, q in want for i in range(a + q, a + n)}
        assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert periods.collapse(docs.limit(0)).count() == 0
    assert any(r["runs"] for r in rows)


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    texts = [None, "", " \n", "a", *(" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 150))) for _ in range(150)), "ab cd " * 40 + "é " * 30 + "x y z " * 20]
    ids = {i: t for i, t in enumerate(texts)} | {10**12 + 7: texts[-1], None: texts[-1], -3: texts[-1]}
    # some of the ids that are made periodic have odd texts
    chosen = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 10 == 0]
    ids |= dict(zip(chosen, [None, "", "one", *texts[-40:]]))
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ids.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in ids.items():
        w, h = WORD.findall(t or ""), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = slow_runs(w)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {k for a, n, q in found for k in range(a + q, a + n)}
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((order(i), len(found), *four, sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = [(order(r[0]), *r[1:]) for r in periods.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
