"""Order statistics of stretches of a sequence, for many stretches at once, in numpy.

A wavelet matrix splits a sequence of small integers by one bit after the other, from the highest
down, and keeps the order inside both halves.  The t-th smallest value of any stretch is found by
walking down the bits: the number of zeros in the stretch says on which side it lies.
"""

from __future__ import annotations

import numpy as np


def nth_smallest(values: np.ndarray, start: np.ndarray, end: np.ndarray, t: np.ndarray,
                 before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch [start, end) of ``values`` (non-negative integers), its ``t``-th smallest
    value (from 0) and how many of the equal ones come before it.

    ``before``: count of each value 0, 1, ... that every stretch holds besides its own.
    """
    most = max(int(values.max(initial=0)), 0 if before is None else len(before) - 1)
    bits = max(1, most.bit_length())
    start, end, t = start.astype(np.int64), end.astype(np.int64), t.astype(np.int64)
    found = np.zeros(len(t), np.int64)
    total = None
    if before is not None:
        total = np.zeros((1 << bits) + 1, np.int64)
        total[1:len(before) + 1] = np.cumsum(before)
        total[len(before) + 1:] = total[len(before)]
    rest = values.astype(np.int64)
    for bit in range(bits - 1, -1, -1):
        one = (rest >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~one)])
        zs, ze = zeros[start], zeros[end]
        low = ze - zs
        if total is not None:
            low = low + total[found + (1 << bit)] - total[found]
        right = t >= low
        t = np.where(right, t - low, t)
        start = np.where(right, zeros[-1] + start - zs, zs)
        end = np.where(right, zeros[-1] + end - ze, ze)
        found = np.where(right, found | (1 << bit), found)
        rest = np.concatenate([rest[~one], rest[one]])
    return found, t


def count_below(values: np.ndarray, start: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each stretch [start, end) of ``values`` (non-negative integers), how many are less than ``bound``."""
    bits = max(1, int(values.max(initial=0)).bit_length())
    bound = bound.astype(np.int64)
    all_below = bound >> bits > 0
    start, end, size = start.astype(np.int64), end.astype(np.int64), (end - start).astype(np.int64)
    count = np.zeros(len(bound), np.int64)
    rest = values.astype(np.int64)
    for bit in range(bits - 1, -1, -1):
        one = (rest >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~one)])
        zs, ze = zeros[start], zeros[end]
        right = (bound >> bit) & 1 == 1
        count += np.where(right, ze - zs, 0)
        start = np.where(right, zeros[-1] + start - zs, zs)
        end = np.where(right, zeros[-1] + end - ze, ze)
        rest = np.concatenate([rest[~one], rest[one]])
    return np.where(all_below, size, count)


def ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each value, ties in order; the values in order)."""
    order = np.argsort(values, kind="stable")
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values))
    return out, values[order]
