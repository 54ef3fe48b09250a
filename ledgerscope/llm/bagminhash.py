"""Weighted MinHash signatures of multisets by hierarchical Poisson processes, in numpy.

The weight axis is cut into the dyadic intervals [0, 1), [1, 2), [2, 4), [4, 8), ...  Every
(element, interval) owns a Poisson process of rate m per unit of weight, drawn from a generator
seeded by the element and the interval: each point has a time, one of m components and a unit cell of the
interval.  A multiset sees the points whose cell lies below the element's weight, and a
component's value is the earliest point that it sees there.  For two multisets a component agrees with
probability sum(min) / sum(max) of their weights, the weighted Jaccard similarity, without bias.

Times grow along a process, so it is followed only up to the time by which all components
of the multiset are filled: about m ln m points per multiset, however many elements it has.
"""

from __future__ import annotations

import math

import numpy as np

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S11, _S32 = (np.uint64(n) for n in (30, 27, 31, 11, 32))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x + _C1
    x = (x ^ (x >> _S30)) * _C2
    x = (x ^ (x >> _S27)) * _C3
    return x ^ (x >> _S31)


def unit(h: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1] from hashes."""
    return ((h >> _S11).astype(np.float64) + 1.0) * 2.0 ** -53


def intervals(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(element number, interval number) of every dyadic interval that begins below the weight."""
    n = np.where(weight <= 1, 1, 1 + np.ceil(np.log2(np.maximum(weight, 1).astype(np.float64))).astype(np.int64))
    n = np.where(weight > 2.0 ** (n - 1), n + 1, n)          # guards the rounding of log2
    n = np.where((n > 1) & (weight <= 2.0 ** (n - 2)), n - 1, n)
    element = np.repeat(np.arange(len(weight)), n)
    return element, np.arange(len(element)) - np.repeat(np.cumsum(n) - n, n)


def _follow(best, e, k, doc, ident, weight, limit, m: int, unit_cells: bool) -> None:
    """Follow the processes of elements ``e`` over intervals ``k`` up to their documents' time
    limits and lower ``best`` to the points seen.  ``unit_cells``: all intervals are [0, 1), of which
    every element sees the one cell."""
    d = doc[e]
    seed = mix(ident[e].astype(np.uint64) ^ (k.astype(np.uint64) * _C2))
    time = np.zeros(len(e))
    low = 2 ** np.maximum(k - 1, 0)
    w = weight[e]
    width = None if unit_cells else low.astype(np.float64)
    big = np.uint64(m)
    while len(d):
        seed = seed + _C3
        h = mix(seed)
        step = np.log(unit(h))
        time = time - (step / m if unit_cells else step / (m * width))
        on = time <= limit[d]
        seed, time, d, h = seed[on], time[on], d[on], h[on]
        g = mix(h ^ _C1)
        at = d * m + (((g >> _S32) * big) >> _S32).astype(np.int64)
        if unit_cells:
            np.minimum.at(best, at, time)
            continue
        low, w, width = low[on], w[on], width[on]
        cell = low + (unit(mix(g)) * width * (1 - 2.0 ** -53)).astype(np.int64)
        seen = cell < w
        np.minimum.at(best, at[seen], time[seen])


def signatures(doc: np.ndarray, ident: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """[n_docs, m] times of the earliest points (the signature; equal times are equal points).

    ``doc``, ``ident`` (64-bit) and ``weight`` (integers >= 1) describe the elements; rows of
    documents without elements stay infinite.
    """
    best = np.full(n_docs * m, np.inf)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    limit = np.where(total > 0, (math.log(m) + 2.0) / np.maximum(total, 1), 0.0)
    todo = total > 0
    element, level = intervals(weight)
    while todo.any():
        here = todo[doc[element]]
        for unit_cells in (True, False):
            part = here & ((level == 0) == unit_cells)
            _follow(best, element[part], level[part], doc, ident, weight, limit, m, unit_cells)
        filled = np.isfinite(best.reshape(n_docs, m)).all(axis=1)
        todo &= ~filled
        limit = np.where(todo, limit * 2, limit)
    return best.reshape(n_docs, m)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the weighted Jaccard similarity from two signatures."""
    return float((a == b).mean())
