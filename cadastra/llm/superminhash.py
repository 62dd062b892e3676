"""SuperMinHash signatures of many sets at once."""

from __future__ import annotations

import numpy as np

from cadastra.llm.words import mix

GOLDEN = 0x9E3779B97F4A7C15


def signatures(values: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """The m-place signatures (rows) of sets whose elements are 64-bit hashes, one set after another; 0 places are empty.

    Each element draws a random permutation of the places, as it is needed, and a fraction a step: at step j it offers
    j + fraction to the j-th place of its permutation. A place keeps its least offer, so elements don't fall on
    places independently, which lowers the variance. A set stops after step j once all of its places hold less than
    j + 1: no later offer can be less. Values are j in the high 32 bits and the fraction in the low ones.
    """
    out = np.full(len(counts) * m, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    places = out.reshape(-1, m)
    live = np.flatnonzero(counts)
    swaps: list[np.ndarray] = []  # the place that each earlier step swapped with its own
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    for j in range(m):
        if not len(live):
            break
        drawn = mix(values + np.uint64((j + 1) * GOLDEN & 0xFFFFFFFFFFFFFFFF))
        swap = (((drawn & low) * np.uint64(m - j)) >> half).astype(np.int64) + j
        place = swap.copy()
        for t in range(j - 1, -1, -1):  # what stands in that place now, swap by swap back to the start
            np.copyto(place, t, where=place == swaps[t])
        np.minimum.at(out, owner * m + place, (drawn >> half) | np.uint64(j << 32))
        waiting = places[live].max(axis=1) >= np.uint64((j + 1) << 32)
        if not waiting.all():
            on = np.zeros(len(counts), bool)
            live = live[waiting]
            on[live] = True
            stay = on[owner]
            values, owner, swap = values[stay], owner[stay], swap[stay]
            swaps = [s[stay] for s in swaps]
        swaps.append(swap)
    return places


def band_keys(places: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` places; keys of different bands differ."""
    bands = places.shape[1] // rows
    grouped = places[:, : bands * rows].reshape(len(places), bands, rows)
    keys = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(GOLDEN) + np.zeros((len(places), 1), np.uint64)
    for r in range(rows):
        keys = mix(keys ^ mix(grouped[:, :, r] + np.uint64(r + 1)))
    return keys


def packed_codes(places: np.ndarray) -> np.ndarray:
    """2 bits a place, 4 places a byte: enough to tell in how many places two signatures differ, but for one in four."""
    codes = (mix(places) & np.uint64(3)).astype(np.uint8).reshape(len(places), -1, 4)
    return codes[:, :, 0] | codes[:, :, 1] << 2 | codes[:, :, 2] << 4 | codes[:, :, 3] << 6
