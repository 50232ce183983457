"""Shingle sets and block signatures of many texts at once, in numpy, for Python workers.

Words are hashed from the bytes of all texts laid end to end (prefix sums of a polynomial, so no loop over words),
shingles from their words' hashes, 64 bits each.
"""

from __future__ import annotations

import functools
import math

import numpy as np

U = np.uint64
GROUP_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(256, dtype=U)) | U(1)
PLACE = mix(np.arange(1000, 1064, dtype=U)) | U(1)
_P = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, U(_P))
    down = np.full(n, U(pow(_P, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the number of words before it (and, last, of all words)."""
    joined = b" ".join(texts) + b" "
    buf = np.frombuffer(joined, dtype=np.uint8)
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.diff(blank.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero((edge == 1) & (np.arange(len(buf)) > 0))
    up, down = _powers(1 << max(len(buf) - 1, 1).bit_length())
    sums = np.concatenate([[U(0)], np.cumsum(BYTE_VALUES[buf] * up[: len(buf)], dtype=U)])
    ends = ends[: len(starts)]
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, ascending within a text, and the bounds of each text's part.

    A text with fewer words than ``width`` is one shingle of all of them; one without words has none.
    """
    words, at = word_hashes([t.encode("utf-8", "surrogatepass").lower() for t in texts])
    n_words = np.diff(at)
    n = np.maximum(n_words - (width - 1), np.minimum(n_words, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    have = np.minimum(n_words[owner], width)
    total = have.astype(U) * PLACE[-1]
    for j in range(width):
        here = j < have
        total[here] += words[first[here] + j] * PLACE[j]
    hashes = mix(total)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def set_keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set, equal for equal sets."""
    sums = [np.concatenate([[U(0)], np.cumsum(mix(hashes ^ U(salt)), dtype=U)]) for salt in (0x5BD1E995, 0xC2B2AE3D27D4EB4F)]
    return tuple(mix(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)


@functools.cache
def size_classes(percent: int) -> list[tuple[int, int, int, int]]:
    """``(least, most, blocks, slack)`` of classes of set sizes, each so wide that partners lie in the same or the next.

    Two sets of Jaccard similarity ``percent`` or more of which the smaller has at most ``most`` elements differ in at
    most ``most * (100 - percent) / percent`` elements. Dealt over one more block than that (by hash), they
    agree in at least one block. ``slack`` more blocks let empty ones be passed over: agreement remains in one block
    that is not empty, as long as a set has no more than ``slack`` empty ones.
    """
    out, least = [], 1
    while least < 1 << 40:
        most = max(least, least * 100 // percent)
        differ = most * (100 - percent) // percent
        slack = 1
        while slack < differ and _tail((differ + 1 + slack) * math.exp(-least / (differ + 1 + slack)), slack) > 1e-4:
            slack += max(1, slack // 8)
        out.append((least, most, differ + 1 + slack if differ else 0, slack))
        least = most + 1
    return out


def _tail(mean: float, k: int) -> float:
    """Probability of more than ``k`` in a Poisson distribution (normal beyond 500)."""
    if mean > 500:
        return 0.5 * math.erfc((k + 0.5 - mean) / math.sqrt(2 * mean))
    term = total = math.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return max(0.0, 1 - total)


def block_signatures(hashes: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the blocks of all sets, the number of the set each belongs to, and how many it needs.

    A set deals its elements in its own size class and, as a possible larger partner, in the class below. Similar sets
    agree in as many blocks of a class as the slack and one, of which no more are empty in both than are empty in either; so a set
    needs at least the rest met by others to be similar to any. The class is told by the lowest bit of that number.
    """
    table = np.array([c for c in size_classes(percent)], dtype=np.int64)
    sizes = np.diff(bounds)
    own = np.searchsorted(table[:, 1], sizes)
    found = []
    for role, cls, joins in ((0, own, sizes > 0), (1, own - 1, (own > 0) & (sizes <= table[own - 1, 1] * 100 // percent))):
        k = np.where(joins, table[cls, 2], 0)
        sets = np.flatnonzero(k > 0)
        if not len(sets):
            continue
        picks = np.repeat(bounds[sets] - np.concatenate([[0], np.cumsum(sizes[sets])[:-1]]), sizes[sets]) + np.arange(sizes[sets].sum())
        h, blocks = hashes[picks], k[sets]
        base = np.concatenate([[0], np.cumsum(blocks)])
        spot = np.repeat(base[:-1], sizes[sets]) + ((mix(h ^ U(0xD6E8FEB86659FD93)) >> U(24)) % np.repeat(blocks, sizes[sets]).astype(U)).astype(np.int64)
        content = np.zeros(base[-1], dtype=U)
        np.add.at(content, spot, mix(h))
        filled = np.bincount(spot, minlength=base[-1]) > 0
        empty = np.add.reduceat(~filled, base[:-1])
        owner = np.repeat(np.arange(len(sets)), blocks)
        keep = filled | (empty > table[cls[sets], 3])[owner]
        place = np.arange(base[-1]) - base[:-1][owner]
        label = mix(cls[sets].astype(U))[owner] + mix(place.astype(U) + U(77))
        need = np.maximum(table[cls[sets], 3] + 1 - empty, 1) * 2 + role
        found.append((mix(content + label)[keep].view(np.int64), sets[owner[keep]], need[owner[keep]]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def groups(texts: list[str], most: int = GROUP_BYTES):
    """Slices of a list of texts of about ``most`` characters each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
