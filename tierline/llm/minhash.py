"""MinHash banding of padded q-grams, with the number of bands taken from the collision curve."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Q-grams hashed at a time: bounds the memory of a batch and of a very long text.
STEP = 4096
#: Fewest values to a band.
SHORTEST = 4


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """The fewest bands of ``rows`` values by which sets of that Jaccard similarity collide with probability ``recall``.

    Collision curve: 1 - (1 - similarity ** rows) ** bands.
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def tuned(others: int, similarity: float, recall: float, background: float, pair: float = 0.05) -> tuple[int, int]:
    """(values to a band, bands) that reach ``recall`` at ``similarity`` with the least work where each set meets ``others`` unlike ones.

    The work of a set are its bands, and ``pair`` of a band's for each unlike set that it collides with by the same curve at
    the ``background`` similarity. So as sets get more, bands get longer, and collisions by chance stay in proportion to the bands.
    """
    cost = lambda rows: (bands := bands_for(similarity, rows, recall)) * (1 + pair * others * background**rows)
    rows = min(range(SHORTEST, 13), key=cost)
    return rows, bands_for(similarity, rows, recall)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def grams_of(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the padded q-grams of all texts, one after the other, and how many each text has."""
    pad, end = "\x01" * (q - 1), "\x02" * (q - 1)
    joined = "".join(pad + t + end for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(t) + 2 * (q - 1) for t in texts], dtype=np.int64)
    n = len(codes) - q + 1
    grams = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(q):
            grams = grams * np.uint64(1_114_133) + codes[i : n + i]
    inside = np.ones(len(codes), dtype=bool)
    ends = np.cumsum(sizes)
    for i in range(1, q):  # the last q - 1 places of a text would run into the next one
        inside[ends - i] = False
    return grams[inside[:n]], sizes - q + 1


def band_keys(q: int, rows: int, bands: int, seed: int = 7, first: int = 0):
    """Arrow UDF: text to one 64-bit key per band over its set of padded q-grams, from the band ``first`` on; null and empty texts give an empty array."""
    seeds = _mix(np.arange(rows * first + 1, rows * (first + bands) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    number = np.arange(first, first + bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def lows(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Least hash of each seed (columns) for each text (rows)."""
        out = np.full((len(counts), len(seeds)), np.iinfo(np.uint64).max, dtype=np.uint64)
        owner = np.repeat(np.arange(len(counts)), counts)
        for at in range(0, len(grams), STEP):
            mine = owner[at : at + STEP]
            first = np.flatnonzero(np.diff(mine, prepend=-1))
            low = np.minimum.reduceat(_mix(grams[at : at + STEP, None] ^ seeds[None, :]), first, axis=0)
            out[mine[first]] = np.minimum(out[mine[first]], low)
        return out

    def keys_of(texts: list[str]) -> np.ndarray:
        low = lows(*grams_of(texts, q)).reshape(len(texts), bands, rows)
        key = np.broadcast_to(number, (len(texts), bands)).copy()
        with np.errstate(over="ignore"):
            for r in range(rows):
                key = _mix(key * np.uint64(31) + low[:, :, r])
        return key.view(np.int64)

    @F.pandas_udf("array<long>")
    def keys(texts: pd.Series) -> pd.Series:
        out: list = [[] for _ in texts]
        there = [i for i, t in enumerate(texts) if t]
        for at in range(0, len(there), 1024):
            some = there[at : at + 1024]
            for i, k in zip(some, keys_of([texts.iloc[i] for i in some]), strict=True):
                out[i] = k
        return pd.Series(out, index=texts.index)

    return keys
