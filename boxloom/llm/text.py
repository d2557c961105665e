"""Hashes of words and of runs of words for many texts at a time, as NumPy arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes that are hashed together; longer texts are cut between words. Bytes of a word that is hashed by itself.
SEGMENT, LONG = 256 << 10, 64
#: Odd numbers that make independent hashes of a word.
_LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_FULL = np.uint64((1 << 64) - 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(raw: bytes, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word; the hash is a function of the word's bytes alone.

    Eight bytes at a time go through a bijective mix, so words of up to eight bytes collide only with words of other
    lengths; words of more than LONG bytes are hashed one by one by BLAKE2b.
    """
    b = np.frombuffer(raw, np.uint8)
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    size = end - start
    eight = np.ndarray(len(b) + 1, "<u8", raw + bytes(8), strides=(1,))
    h = mixed(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(_LANES[lane]))
    live, k = np.flatnonzero(size <= LONG), 0
    while len(live):
        left = np.minimum(size[live] - k, 8).astype(np.uint64)
        part = eight[start[live] + k] & (_FULL >> (np.uint64(64) - left * np.uint64(8)))
        h[live] = mixed(h[live] ^ part * np.uint64(_LANES[lane])) * np.uint64(0x9FB21C651E98DF25)
        k += 8
        live = live[size[live] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8, salt=bytes([lane])).digest(), "little")
    return start, h


def _segments(texts: list[str | None]) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Joined texts of about SEGMENT bytes with (text, its first byte); a long text comes in several."""
    held, places, size = [], [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        at = 0
        while at < len(raw):
            end = len(raw)
            if end - at > SEGMENT:
                end = at + SEGMENT
                while end < len(raw) and not _SPACE[raw[end]]:
                    end += 1
            places.append((i, size))
            held.append(raw[at:end])
            size += end - at + 1
            at = end
            if size >= SEGMENT:
                yield b"\n".join(held), places
                held, places, size = [], [], 0
    if held:
        yield b"\n".join(held), places


def word_hashes(texts: list[str | None], lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, text after text, and the number of words of each text. Each lane (0 or 1) is a hash of its own."""
    parts, n = [], np.zeros(len(texts), np.int64)
    for raw, places in _segments(texts):
        start, h = _hashes(raw, lane)
        parts.append(h)
        where = np.array([p for _, p in places])
        count = np.bincount(np.searchsorted(where, start, side="right") - 1, minlength=len(places))
        np.add.at(n, [i for i, _ in places], count)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), n


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values, over text borders too."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out *= np.uint64(0xA24BAED4963EE407)
        out += h[j : len(h) - k + 1 + j]
    return mixed(out)

