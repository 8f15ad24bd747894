"""Word shingles of whole texts as sorted arrays of 64-bit hashes, computed in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

# Bytes hashed at once; longer texts are cut between words, which does not change the hashes.
PIECE = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_CODES = np.random.default_rng(20_260).integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_CODES[65:91] = BYTE_CODES[97:123]  # A-Z count as a-z
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of one piece."""
    gap = SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    power = np.full(len(data), BASE, dtype=np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[data] * power, out=sums[1:])
    back = np.full(len(data), INVERSE, dtype=np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return starts, mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: Sequence[bytes]) -> Iterator[np.ndarray]:
    """Hashes of the words of each text, in order; words are runs of bytes other than white space."""
    batch: list[bytes] = []
    size = 0
    for text in texts:
        if size + len(text) > PIECE and batch:
            yield from _batch(batch)
            batch, size = [], 0
        if len(text) > PIECE:
            yield _long(text)
            continue
        batch.append(text)
        size += len(text) + 1
        if len(batch) >= 4096:
            yield from _batch(batch)
            batch, size = [], 0
    if batch:
        yield from _batch(batch)


def _batch(batch: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join(batch), dtype=np.uint8)
    starts, hashes = _hash_words(data) if len(data) else (np.zeros(0, int), np.zeros(0, np.uint64))
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in batch])))
    cuts = np.searchsorted(starts, bounds)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield hashes[a:b]


def _long(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, dtype=np.uint8)
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not SPACE[data[end]]:
            step = data[end : end + PIECE]
            hit = np.flatnonzero(SPACE[step])
            end += int(hit[0]) if len(hit) else len(step)
        out.append(_hash_words(data[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; a shorter text is one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(n, width)
    acc = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        acc = acc * BASE + words[k : n - width + 1 + k]
    return np.unique(mix(acc) >> np.uint64(1))  # fits a signed 64-bit column in the same order


def shingle_sets(texts: Sequence[str | None], width: int) -> Iterator[np.ndarray]:
    """The shingle set of each whole text; null and blank texts have an empty one."""
    for words in word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
        yield shingle_set(words, width)


def set_key(values: np.ndarray) -> bytes:
    """128-bit name of a set; equal sets have equal names."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
