"""Words and shingles of whole Arrow batches as 64-bit hashes, with array operations only."""

from __future__ import annotations

from typing import Iterator

import numpy as np

SLICE = 1 << 21  # bytes of text that are hashed at once; a longer text is one slice of its own
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_RNG = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_FACTORS = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def parts(batches, rows: int = 2500):
    """Smaller record batches: bounds the arrays that stand in memory at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, SLICE), base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def words(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Arrow strings without nulls -> slices (number of the first text, word hashes, where each text's words begin, and the end).

    A word is a run of bytes other than [\\x20\\x09-\\x0D]; the hash is a polynomial over its bytes, from running sums.
    """
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    kind = np.int64 if str(texts.type) == "large_string" else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, "right")) - 1)
        b = raw[at[first]:at[last]]
        begins = at[first:last + 1] - at[first]
        if not len(b):
            yield first, np.zeros(0, np.uint64), np.zeros(last - first + 1, np.int64)
            first = last
            continue
        inner = begins[(begins > 0) & (begins < len(b))]
        word = _IS_WORD[b]
        before, after = np.zeros(len(b), bool), np.zeros(len(b), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[inner], after[inner - 1] = False, False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        power, inverse = _power(len(b))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_VALUE[b] * power, out=sums[1:])
        h = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        yield first, h, np.searchsorted(starts, begins)
        first = last


def shingles(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes -> (distinct shingle hashes, text numbers), sorted by text and hash. A text with fewer words is one shingle."""
    n = len(bounds) - 1
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(n), counts)
    if len(h) >= width:
        inside = owner[:len(h) - width + 1] == owner[width - 1:]
        s = np.zeros(len(h) - width + 1, np.uint64)
        for j in range(width):
            s += h[j:len(h) - width + 1 + j] * _FACTORS[j]
        tokens, texts = mixed(s)[inside], owner[:len(h) - width + 1][inside]
    else:
        tokens, texts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.array([(h[bounds[i]:bounds[i + 1]] * _FACTORS[:counts[i]]).sum() + np.uint64(counts[i]) for i in short], np.uint64)
        tokens, texts = np.concatenate([tokens, mixed(extra ^ np.uint64(0x5DEECE66D))]), np.concatenate([texts, short])
        order = np.argsort(texts, kind="stable")
        tokens, texts = tokens[order], texts[order]
    edges = np.searchsorted(texts, np.arange(n + 1))
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        tokens[a:b].sort()
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (texts[1:] != texts[:-1])
    return tokens[new], texts[new]
