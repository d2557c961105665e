"""Language ID: a linear-chain CRF labels each word; affixes, character n-grams and the word itself are its features."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_batches, packed, table, unpacked

#: The sample that the model is fitted on: so many documents of each language at most and so many in all (but one of each), a part of so many characters of each.
SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_CHARS = 150, 9600, 8000
#: Lots that a label's documents are drawn from before the last draw.
LOTS = 64
#: Feature slots, steps of the fit, its rate and L2 penalty, and words of a training sequence.
SLOTS, STEPS, RATE, PENALTY, SEQUENCE = 1 << 17, 40, 0.15, 1e-4, 96
#: Words of a chunk in forward-backward, of a piece of a long text; words whose scores a task remembers.
CHUNK, PIECE, REMEMBERED = 128, 1 << 15, 150_000
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def pieces_of(text: str) -> Iterator[list[str]]:
    """The words of a text, PIECE at a time."""
    found = (m[0] for m in _LETTERS.finditer(text.lower()))
    while piece := list(itertools.islice(found, PIECE)):
        yield piece


def slots(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in `words`, slots): a matrix of feature slots for the words of each width; slot 0 stands for none."""
    size = np.array([len(w) for w in words])
    width = 4 << np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / 4))).astype(int)
    for wide in np.unique(width):
        at = np.flatnonzero(width == wide)
        for part in np.array_split(at, max(1, len(at) * int(wide) // (1 << 17))):
            code = np.array([words[i] for i in part], f"U{wide}").view(np.uint32).reshape(len(part), wide).astype(np.uint64)
            n = size[part]
            found, gram = [], np.zeros_like(code)
            prefix = np.zeros(len(part), np.uint64)
            for k in range(1, 5):  # n-grams of 1 to 4 characters by start
                gram = gram[:, : wide - k + 1] * np.uint64(0x100000001B3) + code[:, k - 1 :] + np.uint64(k << 24)
                here = np.arange(wide - k + 1) <= (n - k)[:, None]
                found.append(np.where(here, _slot(gram, k), 0))
                if k > 1:  # affixes
                    long = n >= k
                    found.append(np.where(long, _slot(gram[:, 0], 10 + k), 0)[:, None])
                    found.append(np.where(long, _slot(gram[np.arange(len(part)), np.maximum(0, n - k)], 20 + k), 0)[:, None])
            for k in range(int(wide)):  # lexicon: the whole word
                prefix = np.where(k < n, prefix * np.uint64(0x9E3779B97F4A7C15) + code[:, k] + np.uint64(1), prefix)
            found.append(_slot(prefix, 30)[:, None])
            yield part, np.concatenate(found, axis=1)


def _slot(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(33)).astype(np.int64) % (SLOTS - 1) + 1


class Crf:
    """Weights of features (slot x label) and of transitions (label x label)."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((SLOTS, len(labels)), np.float32)
        self.moves = np.zeros((len(labels), len(labels)))

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.labels)), np.float32)
        for at, s in slots(words):
            out[at] = self.weights[s].sum(axis=1)
        return out

    def fit(self, texts: list[list[str]], langs: list[int]) -> None:
        """Full-batch AdaGrad on the conditional likelihood of label sequences, spliced from runs of several documents so that labels change within a sequence."""
        rng = np.random.default_rng(7)
        vocabulary: dict[str, int] = {}
        runs = []
        for w, lang in zip(texts, langs):
            ids = [vocabulary.setdefault(x, len(vocabulary)) for x in w]
            cuts = np.cumsum(rng.integers(4, 40, len(ids) // 4 + 1))
            runs += [(np.array(r), lang) for r in np.split(np.array(ids), cuts[cuts < len(ids)]) if len(r)]
        if not runs:
            return
        order = rng.permutation(len(runs))
        flat, label = np.concatenate([runs[i][0] for i in order]), np.concatenate([np.full(len(runs[i][0]), runs[i][1]) for i in order])
        pad = -len(flat) % SEQUENCE
        flat, label = np.append(flat, flat[:1].repeat(pad)).reshape(-1, SEQUENCE), np.append(label, label[:1].repeat(pad)).reshape(-1, SEQUENCE)
        k, n = len(self.labels), flat.size
        blocks = list(slots(list(vocabulary)))
        truth = np.eye(k)[label]
        seen = np.einsum("sta,stb->ab", truth[:, :-1], truth[:, 1:])
        g_w, g_m = np.full((SLOTS, k), 1e-8), np.full((k, k), 1e-8)
        for _ in range(STEPS):
            word = np.empty((len(vocabulary), k))
            for at, s in blocks:
                word[at] = self.weights[s].sum(axis=1)
            marginal, pairs = _expected(word[flat], self.moves)
            off = (marginal - truth).reshape(-1, k)
            by_word = np.stack([np.bincount(flat.ravel(), off[:, j], len(vocabulary)) for j in range(k)], 1) / n
            grad = np.zeros((SLOTS, k))
            for at, s in blocks:
                for j in range(k):
                    grad[:, j] += np.bincount(s.ravel(), by_word[at, j].repeat(s.shape[1]), SLOTS)
            grad[0] = 0
            grad += PENALTY / n * self.weights
            g_w += grad**2
            self.weights -= (RATE * grad / np.sqrt(g_w)).astype(np.float32)
            move = (pairs - seen) / n + PENALTY * self.moves / n
            g_m += move**2
            self.moves -= RATE * move / np.sqrt(g_m)


def _expected(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels (s, t, k) and expected counts of transitions (k, k) for sequences of one length."""
    psi, a = np.exp(scores - scores.max(axis=-1, keepdims=True)), np.exp(moves - moves.max())
    length = scores.shape[1]
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    for t in range(length):
        x = psi[:, t] * (alpha[:, t - 1] @ a if t else 1)
        alpha[:, t] = x / x.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        x = (psi[:, t + 1] * beta[:, t + 1]) @ a.T
        beta[:, t] = x / x.sum(axis=1, keepdims=True)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=-1, keepdims=True)
    pairs = np.einsum("sta,stb->stab", alpha[:, :-1], psi[:, 1:] * beta[:, 1:]) * a
    return marginal, (pairs / pairs.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))


def _norm(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


def _opening(a: np.ndarray) -> np.ndarray:
    """The first word has no transition: its vector before the step matrix solves v @ a = 1."""
    return np.linalg.solve(a.T, np.ones(len(a))) if np.linalg.cond(a) < 1e12 else np.ones(len(a))


def mean_marginals(scores: np.ndarray, moves: np.ndarray, sizes: np.ndarray, entering: np.ndarray | None = None, leaving: np.ndarray | None = None) -> np.ndarray:
    """Mean marginal of each label over the words of each text; texts of `sizes` words (1 or more) stand one after another.

    Forward-backward in chunks: products of the step matrices carry vectors from chunk to chunk, then all chunks run at
    once, so the number of array steps doesn't depend on the longest text. One piece of a longer text has the vectors
    that enter it from the left (null for the first) and from the right.
    """
    k, a = scores.shape[1], np.exp(moves - moves.max())
    psi = np.exp(scores.astype(float) - scores.max(axis=1, keepdims=True))
    start = np.cumsum(sizes) - sizes
    chunks = -(-sizes // CHUNK)
    text = np.repeat(np.arange(len(sizes)), chunks)
    first = np.cumsum(chunks) - chunks
    nth = np.arange(len(text)) - first[text]
    begin, size = start[text] + nth * CHUNK, np.minimum(CHUNK, sizes[text] - nth * CHUNK)
    order = np.argsort(-size, kind="stable")
    begin, live = begin[order], np.searchsorted(-size[order], -np.arange(1, CHUNK + 1), side="right")
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    product = _products(psi, a, begin, live)
    into, back = np.ones((len(text), k)), np.ones((len(text), k))  # what enters a chunk from the left and from the right
    into[place[first]] = _opening(a) if entering is None else entering
    if leaving is not None:
        back[place[first + chunks - 1]] = leaving
    by_length = np.argsort(-chunks, kind="stable")
    many = np.searchsorted(-chunks[by_length], -np.arange(1, int(chunks.max()) + 1), side="right")
    for c in range(int(chunks.max()) - 1):
        d = first[by_length[: many[c + 1]]] + c
        into[place[d + 1]] = _norm(np.maximum(np.einsum("na,nab->nb", into[place[d]], product[place[d]]), 1e-300))
    for c in range(int(chunks.max()) - 1, 0, -1):
        d = first[by_length[: many[c]]] + c
        back[place[d - 1]] = _norm(np.einsum("nab,nb->na", product[place[d]], back[place[d]]))
    alpha = np.empty_like(psi)
    fresh = (nth[order] == 0) & (entering is None)
    now = into
    for t in range(CHUNK):
        if n := live[t]:
            step = now[:n] @ a
            if t == 0:
                step[fresh[:n]] = 1.0
            now[:n] = _norm(step * psi[begin[:n] + t])
            alpha[begin[:n] + t] = now[:n]
    beta, now = np.empty_like(psi), back
    for t in range(CHUNK - 1, -1, -1):
        if n := live[t]:
            at = begin[:n] + t
            beta[at] = now[:n]
            now[:n] = _norm((psi[at] * now[:n]) @ a.T)
    return np.add.reduceat(_norm(alpha * beta), start, axis=0) / sizes[:, None]


def _products(psi: np.ndarray, a: np.ndarray, begin: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Of each chunk, the product of its step matrices; live[t] chunks, the first in order, have more than t words."""
    product = np.tile(np.eye(len(a)), (len(begin), 1, 1))
    for t in range(CHUNK):
        if n := live[t]:
            product[:n] = _norm(product[:n] @ a * psi[begin[:n] + t][:, None, :])
    return product


def mean_of_long(text: str, score: Callable[[list[str]], np.ndarray], moves: np.ndarray) -> np.ndarray:
    """mean_marginals() of one text in pieces, read twice: products of the pieces' step matrices first, then marginals piece by piece."""
    a = np.exp(moves - moves.max())
    steps = []
    for piece in pieces_of(text):
        scores = score(piece).astype(float)
        begin = np.arange(0, len(piece), CHUNK)
        size = np.minimum(CHUNK, len(piece) - begin)
        live = np.searchsorted(-size, -np.arange(1, CHUNK + 1), side="right")
        whole = np.eye(len(a))
        for product in _products(np.exp(scores - scores.max(axis=1, keepdims=True)), a, begin, live):
            whole = whole @ product
            whole /= whole.sum()
        steps.append(whole)
    entering, leaving = [_opening(a)], [np.ones(len(a))]
    for step in steps[:-1]:
        x = np.maximum(entering[-1] @ step, 1e-300)
        entering.append(x / x.sum())
    for step in steps[:0:-1]:
        x = step @ leaving[-1]
        leaving.append(x / x.sum())
    total, n = np.zeros(len(a)), 0
    for i, (piece, last) in enumerate(zip(pieces_of(text), leaving[::-1])):
        size = np.array([len(piece)])
        total += mean_marginals(score(piece), moves, size, entering[i] if i else None, last)[0] * len(piece)
        n += len(piece)
    return total / n


class _Scorer:
    """Remembers the scores of words within a task."""

    def __init__(self, crf: Crf):
        self.crf, self.at, self.table = crf, {}, np.empty((0, len(crf.labels)), np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if len(self.at) + len(new) > REMEMBERED:
            self.at, self.table, new = {}, self.table[:0], list(dict.fromkeys(words))
        if new:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.table = np.concatenate([self.table, self.crf.scores(new)])
        return self.table[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def _label(batches: Iterator[pa.RecordBatch], model, text: str | None) -> Iterator[pa.RecordBatch]:
    scorer = _Scorer(model.value)
    moves = scorer.crf.moves
    labels = np.array([*scorer.crf.labels, UNKNOWN], object)
    for batch in batches:
        texts = (batch.column("text") if text is None else batch.column("rest").field(text)).to_pylist()
        long = [i for i, t in enumerate(texts) if t and len(t) > PIECE]
        found = [[] if i in long else words_of(t) for i, t in enumerate(texts)]
        sizes = np.array([len(w) for w in found])
        has = np.flatnonzero(sizes) if len(labels) > 1 else np.array([], int)
        best, score = np.full(len(found), len(labels) - 1), np.zeros(len(found))
        means = {}
        if len(has):
            means = dict(zip(has.tolist(), mean_marginals(scorer([x for i in has for x in found[i]]), moves, sizes[has])))
        for i in long if len(labels) > 1 else []:
            if _LETTERS.search(texts[i]):
                means[i] = mean_of_long(texts[i], scorer, moves)
        for i, mean in means.items():
            best[i], score[i] = mean.argmax(), np.clip(mean.max(), 0, 1)
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(labels[best], pa.string()), pa.array(score)], ["rest", "lang_pred", "score"])


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, docs_each: int = SAMPLE_DOCS, docs_all: int = SAMPLE_ALL, chars: int = SAMPLE_CHARS) -> Crf:
    """A CRF fitted on the driver to a bounded sample: docs_each documents of each label, fewer where there are so many labels that docs_all would be exceeded, but one at least.

    Every label is learned. A document longer than `chars` characters gives a part of so many, at a place that depends on
    its id. Rows that are held out, or without label, id or text, are never drawn. The rows are those of least xxhash64 of
    the id, so the sample doesn't depend on partitions. Keys are drawn first, in LOTS lots of a label before all of it, and
    each task keeps its least before the shuffle, so a frequent label fills no task; only the parts of drawn keys move.
    """
    own = docs.select("doc_id", "lang", "text")
    free = own.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    labels = [r[0] for r in free.select("lang").distinct().collect()]
    docs_each = max(1, min(docs_each, docs_all // max(1, len(labels))))
    at = F.xxhash64(F.col("doc_id").cast("long"))
    keys = free.select("doc_id", "lang").withColumn("lot", F.pmod(at, F.lit(LOTS)))
    for by in (("lang", "lot"), ("lang",)):
        order = Window.partitionBy(*by).orderBy(at, "doc_id")
        keys = keys.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_each).select("doc_id", "lang", "lot")
    keys = keys.select("doc_id", "lang", F.row_number().over(Window.partitionBy("lang").orderBy(at, "doc_id")).alias("n"))
    begin = F.when(F.length("text") > chars, F.pmod(at, F.length("text") - chars + 1)).otherwise(0) + 1
    part = free.withColumn("part", F.substring("text", begin.cast("int"), F.lit(chars)))
    drawn = part.join(F.broadcast(keys), ["doc_id", "lang"])  # docs_all or one of each label at most
    at_most = Window.partitionBy("lang", "n").orderBy(F.xxhash64("part"))  # rows that repeat an id
    rows = sorted(drawn.select("lang", "n", "part", F.row_number().over(at_most).alias("k")).where("k = 1").select("lang", "n", "part").collect())
    crf = Crf(sorted(labels))
    index = {lang: i for i, lang in enumerate(crf.labels)}
    crf.fit([words_of(r["part"]) for r in rows], [index[r["lang"]] for r in rows])
    return crf


def predict(docs: DataFrame, crf: Crf, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (and the columns in `keep`, whatever their names) for each row of docs(doc_id, text); reads nothing else of a row.

    lang_pred is the label of highest mean marginal over all words of the text, score that mean. Texts that are null or
    without a letter get `und` and 0; so do all if nothing could be learned. Equal texts give equal results; an empty
    table gives none. Row by row in Arrow batches, no shuffle; the model is broadcast (SLOTS x labels floats). Texts of
    more than PIECE characters are scored piece by piece, so only the text itself is held as a whole.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    names = ("doc_id", *keep)
    rows = docs.select(packed(names).alias("rest"), *([] if "text" in keep else ["text"]))  # each text goes to a worker once
    schema = StructType([rows.schema["rest"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    found = rows.mapInArrow(functools.partial(_label, model=spark.sparkContext.broadcast(crf), text=f"c{names.index('text')}" if "text" in keep else None), schema)
    doc_id, *kept = unpacked("rest", names)
    return found.select(doc_id, "lang_pred", "score", *kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES, SQL = {"op7_language_crf": query}, {}
