"""Words and shingles of whole texts as 64-bit hashes, with numpy over the UTF-8 bytes.

Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased, hashed by a polynomial
over random 64-bit values of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Texts are hashed in stretches of about this many bytes, cut at white space.
STRETCH = 512 << 10
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, STRETCH + 1), base)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in order, and where each text's begin (one more than texts). Null: no words."""
    return word_spans(texts)[:2]


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, and each word's first byte and the one after its last, and all bytes."""
    data, at = _bytes_of(texts)
    hashes, firsts, lasts = [], [], []
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + STRETCH)
        if hi < n:
            back = data[lo:hi][::-1]
            cut = np.flatnonzero(_IS_SPACE[back[: 1 << 16]])
            if len(cut):
                hi -= int(cut[0])
            else:  # a very long word: up to the next text or white space
                ahead = np.flatnonzero(_IS_SPACE[data[hi:]])
                hi = min(int(at[np.searchsorted(at, hi)]), hi + int(ahead[0]) if len(ahead) else n)
        part = data[lo:hi]
        up, down = _powers(len(part) + 1)
        inside = ~_IS_SPACE[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = at[(at > lo) & (at < hi)] - lo
        begins[edge] = inside[edge]
        start = np.flatnonzero(begins)
        ends = np.zeros(len(part) + 1, bool)
        ends[1:] = inside
        ends[:-1] &= ~inside | begins
        ends[-1] = len(part) > 0 and inside[-1]
        end = np.flatnonzero(ends)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
        firsts.append(start + lo)
        lasts.append(end + lo)
        lo = hi
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    firsts, lasts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, lasts))
    return hashes, np.searchsorted(firsts, at), firsts, lasts, data


_PLACE = np.array([0xD6E8FEB86659FD93, 0xA5A5B3C1F0E1D2C3, 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0x165667B19E3779F9], np.uint64)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of a text's n-word shingles in order; with fewer words the whole as one; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * _PLACE[k % 5] + np.uint64(k)
        out = mix(out)
    return out


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    words, bounds = word_hashes(texts)
    return [np.unique(shingles(words[a:b], n)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
