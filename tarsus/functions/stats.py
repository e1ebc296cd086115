"""Small statistics in plain Python."""

from __future__ import annotations

import math


def percentile(values: list[float], p: float) -> float | None:
    """Linear interpolation between order statistics; None of nothing."""
    if not values:
        return None
    v = sorted(values)
    at = (len(v) - 1) * p
    lo = math.floor(at)
    hi = min(lo + 1, len(v) - 1)
    return v[lo] + (v[hi] - v[lo]) * (at - lo)


def resampled(x, y, iterations: int, seed: int, chunk: int = 1 << 20):  # noqa: ANN001, ANN201
    """Sums of x and of y (0 or 1) over ``iterations`` samples with replacement: the draws of ``random.Random(seed).randrange(len(x))``, one after another.

    Python draws the first bits of a Mersenne Twister's word until they are below the length; numpy gives the same words in bulk.
    """
    import random

    import numpy as np

    n, k = len(x), len(x).bit_length()
    *words, at = random.Random(seed).getstate()[1]
    twister = np.random.MT19937()
    twister.state = {"bit_generator": "MT19937", "state": {"key": np.array(words, np.uint32), "pos": at}}
    both = x.astype(np.int64) + (y.astype(np.int64) << 32)
    sums, done = np.zeros(iterations, np.int64), 0
    while done < n * iterations:
        drawn = twister.random_raw(chunk) >> np.uint64(32 - k)
        drawn = drawn[drawn < n][: n * iterations - done].astype(np.int64)
        if len(drawn):
            starts = np.r_[0, np.arange(n - done % n, len(drawn), n)]
            sums[done // n : done // n + len(starts)] += np.add.reduceat(both[drawn], starts)
            done += len(drawn)
    return sums & 0xFFFFFFFF, sums >> 32
