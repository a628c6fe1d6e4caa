"""Words, word shingles and MinHash values of a UTF-8 text, by whole-array operations.

Words are runs of bytes other than ASCII white space, as they stand (no folding). A word's hash is
a polynomial of its bytes modulo 2**64, taken from prefix sums, then mixed; a shingle's hash
combines those of its words. Texts with fewer words than a shingle have one shingle of all their
words; texts without words have none.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_TABLES: list[np.ndarray] = [_powers(_BASE, 1 << 12), _powers(_INVERSE, 1 << 12)]


def _tables(n: int) -> list[np.ndarray]:
    if len(_TABLES[0]) < n:
        size = 1 << (n - 1).bit_length()
        _TABLES[:] = [_powers(_BASE, size), _powers(_INVERSE, size)]
    return _TABLES


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of a text; start and end are byte offsets."""
    found = []
    at = 0
    while at < len(text) or not found:
        to = at + _SLICE
        while to < len(text) and not _GAP[text[to]]:
            to += 1
        found.append(_words(text[at:to], at))
        at = to
    return found[0] if len(found) == 1 else tuple(np.concatenate(c) for c in zip(*found))


def _words(text: bytes, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(text, np.uint8)
    gap = np.ones(len(a) + 2, bool)
    gap[1:-1] = _GAP[a]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _tables(len(a) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=prefix[1:])
        hashes = mixed((prefix[ends] - prefix[starts]) * inverse[starts])
    return starts + offset, ends + offset, hashes


def batched(texts: list[bytes], target: int = 1 << 19):
    """(first text, hashes, offsets) of stretches of texts of about so many bytes, a longer text alone: the hashes of all their words, and
    the place of each text's first word in them, with the number of words last. Short texts share the costs of a call."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < target):
            size += len(texts[to]) + 1
            to += 1
        starts, _, hashes = words(b"\n".join(texts[at:to]))
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[at:to]])
        yield at, hashes, np.searchsorted(starts, begins)
        at = to


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of so many words, in order; one of all words if there are fewer."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(size, n)
    power = lambda k: np.uint64(pow(_BASE, k, 1 << 64))
    out, have = hashes, 1  # sums of runs of `have` words, doubled
    with np.errstate(over="ignore"):
        for bit in bin(size)[3:]:
            out, have = out[:-have] * power(have) + out[have:], 2 * have
            if bit == "1":
                out, have = out[:-1] * power(1) + hashes[have:], have + 1
        return mixed(out + np.uint64(size) * power(size))


def windows_at(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Those of windows() that begin at the given places; all must have `size` words."""
    out = np.full(len(at), size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(_BASE) + hashes[at + k]
    return mixed(out)


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The different shingles of a text, ascending."""
    return np.unique(windows(words(text)[2], size))


def coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def minhashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 32-bit MinHash value for each pair of coefficients; shingles must not be empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        h = x[k : k + 1024, None] * a[None, :]
        h += b
        np.minimum(least, h.min(axis=0), out=least)
    return least


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)
