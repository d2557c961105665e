"""Secret scans: exact patterns, and a character network in NumPy over every other candidate with the text around it."""

from __future__ import annotations

import functools
import random
import re
import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import arrow_batches, stored, table

#: Kinds of findings; spans of one start are in this order. `learned` ones are the network's.
KINDS = ("assign", "access", "hex", "learned")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: What an assignment needs in it, in lower case, so that most texts aren't searched.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{24,}")
#: Characters of an assigned value and of an access key, at least.
VALUE, ACCESS = 6, 20
#: A candidate for the network.
CANDIDATE = re.compile("[A-Za-z0-9+/_.-]{16,}={0,2}")
SHORTEST = 16
#: Characters that the network sees: before a candidate, of its start and its end, after it.
BEFORE, HEAD, TAIL, AFTER = 32, 40, 8, 8
WIDTH = BEFORE + HEAD + TAIL + AFTER
#: Labelled findings: different ones that a task fits to at about, made ones of each label that go with these.
SHARD, MADE = 4_096, 4_000
#: The share of labelled secrets of each shape that the thresholds keep, at least, and the secrets a shape needs for a threshold of its own.
RECALL, SHAPED = 0.99, 30
#: Sizes of the network and its training.
EMBED, TAPS, FILTERS, EPOCHS, BATCH, RATE = 8, 7, 32, 12, 64, 0.004
#: How often tasks' weights are averaged, and units that weights and logits are rounded to where they are added up.
ROUNDS, UNIT, BIN = 3, 1 << 32, 1 << 7
SHAPES = ("digits", "letters", "hex", "mixed")


def exact(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact patterns' matches, leftmost and without overlap for each kind; matches that are too short are dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of long runs of key characters, without punctuation at their ends."""
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while start < end and text[start] in "./_-":
            start += 1
        while start < end and text[end - 1] in "./_-":
            end -= 1
        if end - start >= SHORTEST:
            yield start, end


def window(text: str, start: int, end: int) -> str:
    """What the network sees of a candidate, WIDTH characters; characters that aren't there are NUL."""
    body = text[start:end] if end - start <= HEAD + TAIL else text[start : start + HEAD] + text[end - TAIL : end]
    return text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + body.ljust(HEAD + TAIL, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")


def coded(windows: list[str]) -> np.ndarray:
    """Windows as codes below 256: ASCII, one code for all else, one for a character met twice just before; a candidate's own apart from those around it."""
    points = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, WIDTH)
    out = np.minimum(points, 127).astype(np.int64)
    again = (points[:, 2:] == points[:, 1:-1]) & (points[:, 2:] == points[:, :-2]) & (points[:, 2:] > 0)
    out[:, 2:][again] = 1
    out[:, BEFORE : BEFORE + HEAD + TAIL] += 128
    return out


def shapes(windows: list[str]) -> np.ndarray:
    """The shape of each candidate, as a place in SHAPES."""
    out = []
    for w in windows:
        body = w[BEFORE : BEFORE + HEAD + TAIL].rstrip("\0")
        out.append(0 if not re.search("[A-Za-z]", body) else 1 if not re.search("[0-9]", body) else 2 if re.fullmatch("[0-9a-fA-F-]+", body) else 3)
    return np.array(out, np.int64)


_BODY = slice(BEFORE, BEFORE + HEAD + TAIL - TAPS + 1)


def _forward(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits, and what the gradient needs: embedding, convolution, greatest and mean activations in the candidate and in all, one dense layer."""
    e = p["embed"][x]
    cols = np.lib.stride_tricks.sliding_window_view(e, TAPS, axis=1).reshape(len(x), WIDTH - TAPS + 1, EMBED * TAPS)
    a = np.maximum(cols @ p["filter"] + p["bias"], 0)
    body = a[:, _BODY]
    pooled = np.concatenate([a.max(axis=1), body.max(axis=1), body.mean(axis=1)], axis=1)
    return pooled @ p["dense"] + p["offset"], (cols, a, pooled)


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, held: tuple, d: np.ndarray) -> dict[str, np.ndarray]:
    cols, a, pooled = held
    up = d[:, None] * p["dense"]
    da = np.zeros_like(a)
    body = da[:, _BODY]
    rows, units = np.arange(len(x))[:, None], np.arange(FILTERS)
    da[rows, a.argmax(axis=1), units] += up[:, :FILTERS]
    body[rows, a[:, _BODY].argmax(axis=1), units] += up[:, FILTERS : 2 * FILTERS]
    body += up[:, None, 2 * FILTERS :] / body.shape[1]
    da *= a > 0
    flat = da.reshape(-1, FILTERS)
    back = (flat @ p["filter"].T).reshape(len(x), -1, EMBED, TAPS)
    de = np.zeros((len(x), WIDTH, EMBED), a.dtype)
    for k in range(TAPS):
        de[:, k : k + back.shape[1]] += back[..., k]
    at = (x[..., None] * EMBED + np.arange(EMBED)).ravel()
    embed = np.bincount(at, de.ravel(), p["embed"].size).reshape(p["embed"].shape).astype(a.dtype)
    return {"embed": embed, "filter": cols.reshape(-1, EMBED * TAPS).T @ flat, "bias": flat.sum(axis=0), "dense": pooled.T @ d, "offset": d.sum()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """A trained network, the line that makes its logits probabilities, and the least probability of a secret of each shape."""

    weights: dict[str, np.ndarray]
    line: tuple[float, float]
    least: np.ndarray

    def score(self, windows: list[str]) -> np.ndarray:
        out = [np.zeros(0)]
        for at in range(0, len(windows), 512):
            out.append(_sigmoid(_forward(self.weights, coded(windows[at : at + 512]))[0] * self.line[0] + self.line[1]))
        return np.concatenate(out)

    def secret(self, windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(score, whether it is a secret) of each window."""
        score = self.score(windows)
        return score, score >= self.least[shapes(windows)]


def _held(windows: list[str]) -> np.ndarray:
    """Which windows are held out for calibration and thresholds: a quarter, by the candidates' own characters."""
    return np.array([sum(map(ord, w[BEFORE : BEFORE + HEAD + TAIL])) % 4 == 0 for w in windows], bool)


def _begun(rng: np.random.Generator) -> dict[str, np.ndarray]:
    init = lambda *shape: (rng.standard_normal(shape) * (2 / shape[0]) ** 0.5).astype(np.float32)
    return {"embed": rng.standard_normal((256, EMBED)).astype(np.float32) * np.float32(0.5), "filter": init(EMBED * TAPS, FILTERS), "bias": np.zeros(FILTERS, np.float32), "dense": init(3 * FILTERS) * np.float32(0.3), "offset": np.float32(0)}


def _trained(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, epochs: range, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """The weights after some of all EPOCHS over x."""
    p = dict(p)
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in epochs:
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            logits, kept = _forward(p, x[at])
            grads = _gradients(p, x[at], kept, ((_sigmoid(logits) - y[at]) / max(1, len(at))).astype(np.float32))
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def _logits(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[_forward(p, part)[0] for part in np.array_split(x, len(x) // 512 + 1)]]).astype(np.float64)


def _model(p: dict[str, np.ndarray], z: np.ndarray, y: np.ndarray, kind: np.ndarray, n: np.ndarray) -> Model:
    """The calibrated network: logits, labels, shapes and numbers of held-out candidates.

    The threshold of a shape is the greatest that still finds RECALL of the shape's held-out secrets; shapes with fewer than
    SHAPED of them take the threshold of all.
    """
    line = _calibrated(z, y, n)
    score = _sigmoid(z * line[0] + line[1])

    def least_of(own: np.ndarray) -> float:
        order = np.argsort(score[own], kind="stable")
        upto = np.cumsum(n[own][order])
        return score[own][order][np.searchsorted(upto, int(upto[-1] * (1 - RECALL)), "right")]

    wanted = y > 0
    overall = least_of(wanted) if wanted.any() else 1.0
    return Model(p, line, np.array([least_of(own) if n[own := wanted & (kind == k)].sum() >= SHAPED else overall for k in range(len(SHAPES))]))


def fit(windows: list[str], labels: list[int], seed: int = 0) -> Model:
    """A model of labelled windows, without tasks."""
    x, y, held, rng = coded(windows), np.array(labels, np.float32), _held(windows), np.random.default_rng(seed)
    p = _trained(_begun(rng), x[~held], y[~held], range(EPOCHS), rng)
    return _model(p, _logits(p, x[held]), y[held].astype(np.float64), shapes([w for w, own in zip(windows, held) if own]), np.ones(int(held.sum()), np.int64))


def _calibrated(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of logits, each met n times, by Newton's method, with targets drawn in by one case of each label (Platt, 1999)."""
    yes, no = (y * n).sum(), ((1 - y) * n).sum()
    target, w = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2)), np.array([1.0, 0.0])
    design = np.stack([z, np.ones_like(z)], 1)
    for _ in range(30):
        s = _sigmoid(design @ w)
        hessian = design.T @ (design * (n * s * (1 - s))[:, None]) + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hessian, design.T @ (n * (s - target)) + 1e-3 * (w - [1.0, 0.0]))
    return max(float(w[0]), 1e-3), float(w[1])


_ALNUM, _BASE64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
#: Formats of public services' keys (fixed values): a prefix, the alphabet and the lengths of what follows.
FORMATS = (
    ("", _BASE64, (40, 40)), ("", _BASE64, (24, 88)), ("", _ALNUM, (20, 64)), ("", _ALNUM + "_-", (24, 64)), ("", string.ascii_lowercase + string.digits, (20, 40)), ("", string.ascii_uppercase + string.digits, (20, 40)),
    ("", "0123456789ABCDEF", (24, 64)), ("", "0123456789abcdef", (24, 64)), ("ghp_", _ALNUM, (36, 36)), ("gho_", _ALNUM, (36, 36)), ("github_pat_", _ALNUM + "_", (82, 82)), ("glpat-", _ALNUM + "_-", (20, 20)),
    ("sk_live_", _ALNUM, (24, 24)), ("rk_live_", _ALNUM, (24, 24)), ("sk-", _ALNUM, (48, 48)), ("AIza", _ALNUM + "_-", (35, 35)), ("ya29.", _ALNUM + "_-", (60, 120)), ("xoxb-", string.digits, (24, 24)), ("npm_", _ALNUM, (36, 36)),
    ("SG.", _ALNUM + "_-", (66, 66)), ("eyJhbGciOiJIUzI1NiJ9.eyJ", _ALNUM + "_-", (60, 120)), ("AKIA", string.ascii_uppercase + string.digits, (16, 16)), ("dop_v1_", "0123456789abcdef", (64, 64)), ("SK", "0123456789abcdef", (32, 32)),
)
_ONSETS = ("", "b", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "qu", "r", "s", "t", "v", "w", "y", "z", "st", "tr", "pr", "th", "ch", "sh", "bl", "cr", "fl", "gr", "pl", "sp", "br", "cl", "dr", "sch")
_VOWELS, _ENDS = ("a", "e", "i", "o", "u", "ea", "ou", "io", "ie", "ai"), ("", "", "n", "r", "s", "t", "l", "m", "ng", "nt", "st", "ck", "nd", "ll", "rm", "tion", "x")
#: What stands before keys in files (fixed values).
LEADS = ("key: ", "key = \"", "Authorization: Bearer ", "Authorization: Basic ", "export AWS_SECRET_ACCESS_KEY=", "\"client_secret\": \"", "credentials: ", "auth=", "private_key = '", "--header 'X-Auth: ", "SharedAccessKey=", "AccountKey=", "signature=", "pwd: ")


def _secret(rnd: random.Random) -> str:
    prefix, letters, (a, b) = rnd.choice(FORMATS)
    body = "".join(rnd.choices(letters, k=rnd.randint(a, b)))
    if prefix == "xoxb-":
        body = f"{body[:12]}-{body[12:]}-{''.join(rnd.choices(_ALNUM, k=24))}"
    if prefix == "SG.":
        body = f"{body[:22]}.{body[23:]}"
    if prefix.startswith("eyJ"):
        body = f"{body[:40]}.{body[41:]}"
    return prefix + body + (rnd.choice(("", "=", "==")) if not prefix and letters is _BASE64 else "")


def _spoken(rnd: random.Random) -> str:
    """A made word of one to four syllables."""
    return "".join(rnd.choice(_ONSETS) + rnd.choice(_VOWELS) + rnd.choice(_ENDS) for _ in range(rnd.randint(1, 4)))


def _harmless(rnd: random.Random, words: list[str]) -> str:
    """What looks like a key and is none: joined words, names, paths, numbers, dates, identifiers, rules of repeated characters."""
    some = [rnd.choice(words) if rnd.random() < 0.5 else _spoken(rnd) for _ in range(rnd.randint(2, 8))]
    digits = lambda n: "".join(rnd.choices(string.digits, k=n))
    made = rnd.choice((
        lambda: "".join(some), lambda: "".join(w.capitalize() for w in some), lambda: "_".join(some), lambda: "-".join(some), lambda: ".".join(some), lambda: "/".join(some), lambda: "_".join(some).upper(),
        lambda: f"www.{some[0]}.{rnd.choice(('com', 'org', 'de'))}/{'/'.join(some)}", lambda: f"{'.'.join(some[:2])}.{digits(2)}", lambda: f"/usr/local/lib/{some[0]}{digits(1)}.{digits(2)}/{some[-1]}.py",
        lambda: f"{some[0]}-{digits(1)}.{digits(2)}.{digits(1)}-{some[-1]}.tar.gz", lambda: f"{'_'.join(some)}_{digits(4)}", lambda: "".join(w.capitalize() for w in some) + digits(2),
        lambda: str(uuid.UUID(int=rnd.getrandbits(128))), lambda: digits(rnd.randint(16, 24)), lambda: f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}T{digits(2)}-{digits(2)}-{digits(2)}.{digits(6)}",
        lambda: f"{digits(2)}/{digits(2)}/{digits(4)}-{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"3.{digits(18)}", lambda: f"+{digits(2)}-{digits(3)}-{digits(4)}-{digits(4)}", lambda: f"{digits(1)}e-{digits(2)}/{digits(9)}.{digits(6)}",
        lambda: rnd.choice(string.ascii_letters + "-=_.x0xX*#") * rnd.randint(16, 60), lambda: str(uuid.UUID(int=rnd.getrandbits(128))).upper(), lambda: (rnd.choice(some) + rnd.choice("-_.")) * rnd.randint(4, 9), lambda: "".join(rnd.choices("01", k=rnd.randint(16, 48))), lambda: "".join(rnd.choices("ACGT", k=rnd.randint(16, 60))),
        lambda: "0123456789abcdefghijklmnopqrstuvwxyz"[rnd.randint(0, 9) :], lambda: "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[rnd.randint(0, 9) :],
    ))()
    return made


def made_findings(contexts: list[str], n: int, seed: int = 0) -> tuple[list[str], list[int]]:
    """n secrets by FORMATS and n harmless candidates as labelled windows; `contexts` are texts that half of them are set in, made words are around the others."""
    rnd = random.Random(seed)
    contexts = [c for c in contexts if c.strip()]
    around = lambda: rnd.choice(contexts) if contexts and rnd.random() < 0.5 else rnd.choice((" ", ", ", "\n", "_", " = ")).join(_spoken(rnd) for _ in range(5))
    words = sorted({w for c in contexts for w in re.findall("[A-Za-z]{2,12}", c)}) or ["value", "step", "name"]
    out, labels = [], []
    for label in (1, 0):
        made = 0
        while made < n:
            body = _secret(rnd) if label else _harmless(rnd, words)
            if not (found := list(candidates(body))) or found[0][1] - found[0][0] < min(len(body), SHORTEST):
                continue
            lead = around() + rnd.choice((" ", "\n", ": ", " \"", "=", " (", "; ", "|"))
            lead += rnd.choice(LEADS) if rnd.random() < (0.5 if label else 0.1) else ""
            text = lead + body + rnd.choice((" ", "\n", "\"", ")", ". ", ", ", "")) + around()
            out.append(window(text, len(lead) + found[0][0], len(lead) + found[0][1]))
            labels.append(label)
            made += 1
    return out, labels


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of all candidates, labelled by whether an exact match covers them."""
    for batch in batches:
        windows, labels = [], []
        for text in batch.column("_text").to_pylist():
            spans = exact(text or "")
            for a, z in candidates(text or ""):
                windows.append(window(text, a, z))
                labels.append(int(any(s < z and a < e for s, _, e in spans)))
        yield pa.RecordBatch.from_arrays([pa.array(windows, pa.string()), pa.array(labels, pa.int32())], ["window", "label"])


def _cases(t: pa.Table, made: int) -> pa.Table:
    """A shard's labelled windows, in an order of their own: what was found, the same in other surroundings, so that not the words beside them alone decide, and made ones."""
    rows = sorted(zip(t.column("window").to_pylist(), t.column("label").to_pylist()))
    around = sorted({w[:BEFORE].strip("\0") for w, _ in rows})
    moved = [(around[i * 7919 % len(around)].rjust(BEFORE, "\0") + w[BEFORE:], label) for i, (w, label) in enumerate(rows)]
    shard = int(t.column("shard")[0].as_py())
    more, labels = made_findings(around, made, shard)
    windows, labels = [*[w for w, _ in rows + moved], *more], [*[label for _, label in rows + moved], *labels]
    return pa.table({"shard": pa.array([shard] * len(windows), pa.int32()), "place": pa.array(range(len(windows)), pa.int32()), "window": pa.array(windows, pa.string()), "label": pa.array(labels, pa.int32())})


def _read(t: pa.Table) -> tuple[list[str], np.ndarray]:
    t = t.sort_by("place")
    return t.column("window").to_pylist(), t.column("label").to_numpy()


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([np.ravel(v) for v in p.values()]).astype(np.float64)


def _like(p: dict[str, np.ndarray], flat: np.ndarray) -> dict[str, np.ndarray]:
    parts = np.split(flat.astype(np.float32), np.cumsum([np.size(v) for v in p.values()])[:-1])
    return {k: x.reshape(np.shape(v)) if np.ndim(v) else x[0] for (k, v), x in zip(p.items(), parts)}


def _round(t: pa.Table, p: dict[str, np.ndarray], epochs: range) -> pa.Table:
    windows, labels = _read(t)
    train, y = ~_held(windows), labels.astype(np.float32)
    own = _flat(_trained(p, coded(windows)[train], y[train], epochs, np.random.default_rng(epochs.start)))
    return pa.table({"place": pa.array(np.arange(len(own), dtype=np.int32)), "value": pa.array(np.rint(own * UNIT).astype(np.int64))})


def _judged(t: pa.Table, p: dict[str, np.ndarray]) -> pa.Table:
    windows, labels = _read(t)
    held = np.flatnonzero(_held(windows))
    mine = [windows[i] for i in held]
    z = np.rint(np.clip(_logits(p, coded(mine)), -30, 30) * BIN).astype(np.int64)
    rows, n = np.unique(np.stack([labels[held].astype(np.int64), shapes(mine), z]), axis=1, return_counts=True)
    return pa.table({"label": rows[0], "kind": rows[1], "z": rows[2], "n": n})


def _dealt(df: DataFrame, shards: int) -> GroupedData:
    """df by shard, dealt by ranges of them: by hashes some tasks would have several shards and others none, which each round would wait for."""
    return df.repartitionByRange(shards, "shard").groupBy("shard")


def train(docs: DataFrame, made: int = MADE) -> Model:
    """A model of all of docs(doc_id, text), and of made findings.

    Labelled findings are the candidates of every document, secrets where an exact pattern matches; equal ones in equal
    surroundings are one. Shards of them, each with `made` findings of each label by known formats, train in tasks, and
    weights are averaged ROUNDS times; a shard's cases are made once and written. The line and the thresholds come from counts of all held-out logits. A table without
    candidates leaves the made findings.
    """
    arrow_batches(docs.sparkSession)
    windows = docs.select(F.col("text").alias("_text")).mapInArrow(_labelled, "window string, label int").distinct()
    windows = stored(windows, "labelled")
    shards = -(-windows.count() // SHARD)
    if not shards:
        return fit(*made_findings([], made))
    found = windows.withColumn("shard", F.pmod(F.xxhash64("window"), F.lit(shards)).cast("int"))
    cases = _dealt(found, shards).applyInArrow(lambda t: _cases(t, made), "shard int, place int, window string, label int")
    dealt = _dealt(stored(cases, "cases"), shards)
    p, each = _begun(np.random.default_rng(0)), EPOCHS // ROUNDS
    for k in range(ROUNDS):
        now, epochs = p, range(k * each, (k + 1) * each)
        own = dealt.applyInArrow(lambda t: _round(t, now, epochs), "place int, value bigint")  # noqa: B023
        mean = own.groupBy("place").agg((F.sum(F.col("value").cast("decimal(38,0)")) / F.count("*")).cast("double").alias("v"))
        p = _like(p, np.array([r["v"] for r in sorted(mean.collect())]) / UNIT)
    rows = dealt.applyInArrow(lambda t: _judged(t, p), "label bigint, kind bigint, z bigint, n bigint").groupBy("label", "kind", "z").agg(F.sum("n").alias("n"))
    y, kind, z, n = np.array(sorted(rows.collect()), np.int64).reshape(-1, 4).T
    return _model(p, z / BIN, y.astype(np.float64), kind, n)


_SPAN = StructType().add("kind", "string").add("start", "long").add("end", "long").add("score", "double")


def _scan(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, windows, places = [], [], []
        for i, text in enumerate(batch.column("_text").to_pylist()):
            text = text or ""
            spans = exact(text)
            found.append([(*s, 1.0) for s in spans])
            if model is not None:
                for a, z in candidates(text):
                    if not any(s < z and a < e for s, _, e in spans):
                        windows.append(window(text, a, z))
                        places.append((i, a, z))
        if windows:
            score, yes = model.secret(windows)
            for k in np.flatnonzero(yes).tolist():
                i, a, z = places[k]
                found[i].append((a, 3, z, float(score[k])))
        rows = [[{"kind": KINDS[k], "start": a, "end": z, "score": s} for a, k, z, s in sorted(x)] for x in found]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(rows, kind)], ["row", "spans"])


def scan(docs: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row of docs(text): row (a struct of the columns in `keep`) and spans (kind, start, end, score), by start, then kind.

    Places are code points, ends exclusive. The exact kinds stand as they match; `learned` ones are candidates that overlap
    none of them and that the model takes for secrets. A null or empty text has no span; rows that repeat give the same
    twice; an empty table gives none; kept columns may have any name. Row by row in Arrow batches, no shuffle; a long text
    is held whole by one task with the windows of its candidates.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col("text").alias("_text"))
    schema = rows.select(F.col("_row").alias("row")).schema.add("spans", ArrayType(_SPAN))
    return rows.mapInArrow(functools.partial(_scan, model=model), schema)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs)).select("row.doc_id", "spans")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "learned")
    return found.select("doc_id", *map(of, KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES, SQL = {"op12_secret_scan": query}, {}
