"""Hashed character n-grams of many texts at once, in numpy, for Python workers."""

from __future__ import annotations

import numpy as np

from claimweave.llm.shingle_arrays import PLACE, U, groups

ORDERS = (4, 5, 7, 9)
BITS = 20
#: Characters taken at once; longer texts are cut into overlapping pieces.
GROUP = 250_000


def grams(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the given orders, repeats included, and the text each belongs to.

    Texts are in lower case, white space is one blank, and a blank stands at both ends, so n-grams know where words begin
    and end.
    """
    plain = [f" {' '.join(t.split()).lower()} " for t in texts]
    return _grams_of("".join(plain), np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in plain]), bits)


def _grams_of(joined: str, owner: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U)
    buckets, owners = [], []
    total = np.zeros(len(points), dtype=U)
    for j in range(max(ORDERS)):
        n = len(points) - j
        if n <= 0:
            break
        total = total[:n] + points[j:] * PLACE[j]
        if j + 1 in ORDERS:
            mixed = (total ^ (total >> U(29))) * PLACE[40 + j]
            whole = owner[j:] == owner[:n]
            buckets.append((mixed >> U(64 - bits)).astype(np.int32)[whole])
            owners.append(owner[:n][whole])
    if not buckets:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    return np.concatenate(buckets), np.concatenate(owners)


def in_groups(texts: list[str], wanted: np.ndarray | None = None):
    """Slices ``a, b`` of ``texts`` with the distinct buckets of their texts and their owners, from ``a`` on.

    ``wanted``: a mask of buckets; others are left out. Memory is bounded by ``GROUP`` and the number of buckets.
    """

    def pick(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        buckets, owners = grams(some)
        if wanted is not None:
            use = wanted[buckets]
            buckets, owners = buckets[use], owners[use]
        return distinct(buckets, owners)

    for a, b in groups(texts, GROUP):
        if sum(len(t) for t in texts[a:b]) <= 2 * GROUP:
            yield a, b, *pick(texts[a:b])
            continue
        # the last of the slice is a long text: white space is one blank in it, so that pieces join as the text does
        if b - a > 1:
            yield a, b - 1, *pick(texts[a:b - 1])
        text, overlap = " ".join(texts[b - 1].split()).lower(), max(ORDERS) - 1
        ends = [(max(0, at - overlap), at + GROUP) for at in range(0, max(len(text), 1), GROUP)]
        found = [_inner(text, x, y, wanted) for x, y in ends]
        buckets = np.unique(np.concatenate(found))
        yield b - 1, b, buckets, np.zeros(len(buckets), dtype=np.int32)


def _inner(text: str, start: int, end: int, wanted: np.ndarray | None) -> np.ndarray:
    """Buckets of a piece of a long text in lower case with single blanks, with a blank before the first and after the last piece."""
    piece = (" " if start == 0 else "") + text[start:end] + (" " if end >= len(text) else "")
    buckets, _ = _grams_of(piece, np.zeros(len(piece), dtype=np.int32), BITS)
    return np.unique(buckets if wanted is None else buckets[wanted[buckets]])


def distinct(buckets: np.ndarray, owners: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket once per text, texts ascending."""
    both = np.unique((owners.astype(np.int64) << bits) | buckets)
    return (both & ((1 << bits) - 1)).astype(np.int32), (both >> bits).astype(np.int32)
