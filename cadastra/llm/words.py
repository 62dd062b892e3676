"""Hashes of words and of word shingles for whole batches of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space parts words.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
KEPT_POWERS = 1 << 23
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64; kept, as every batch needs them, but for those of a very long text."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, (n - 1).bit_length())
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= KEPT_POWERS:
            _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with a line feed after each, first byte of each text and the end of all)."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    data = np.frombuffer(("\n".join(texts.to_pylist()) + "\n").encode() if len(texts) else b"", np.uint8)
    return data, np.concatenate([[0], np.cumsum(sizes)])


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, 64-bit hash) of each word of data, which ends with white space."""
    word = ~IS_WHITE[data]
    edge = np.flatnonzero(np.diff(word, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), dtype=np.uint64)])
    own = (sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts]
    return starts, ends, mix(own + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' distinct k-word shingles, sorted within each text, and how many each text has).

    Words are lower-cased in A-Z. A text of fewer words has one shingle, all of them; one without words has none.
    """
    data, bounds = joined(texts)
    starts, _, hashes = word_hashes(LOWER[data])
    per_text = np.diff(np.searchsorted(starts, bounds))
    first = np.cumsum(per_text) - per_text
    rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        factor = np.uint64(pow(0xC2B2AE3D27D4EB4F, 2 * j + 1, 1 << 64) | 1)
        rolled += hashes[j : len(hashes) - k + 1 + j] * factor
    full = per_text >= k
    many = np.where(full, per_text - k + 1, 0)
    owner = np.repeat(np.arange(len(per_text)), many)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    values = mix(rolled[first[owner] + inside]) if len(owner) else np.zeros(0, np.uint64)
    few = np.flatnonzero((per_text > 0) & ~full)
    if len(few):  # the words in their places, and how many
        extra = []
        for i in few:
            total = int(per_text[i])
            for j in range(int(per_text[i])):
                total = (total * BASE + int(hashes[first[i] + j])) & 0xFFFFFFFFFFFFFFFF
            extra.append(total)
        owner, values = np.concatenate([owner, few]), np.concatenate([values, mix(np.array(extra, np.uint64))])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return values[new], np.bincount(owner[new], minlength=len(per_text))
