"""Counts of a leg's matches inside (pair, stretch of time), in numpy inside tasks (``detectors.round_trip_counts``).

The rows of a place, sorted by direction and step, are a sequence in which the second legs of a first leg are one
stretch; how many of them have an amount between two bounds, and the greatest of these, are order statistics of
stretches (``functions.wavelet``).  Many places are worked on at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerscope.functions.wavelet import count_below, nth_smallest

#: Rows that are worked on at once (whole places, so a larger place has more).
BLOCK = 1 << 17


def tolerated(m: np.ndarray, side: int, tolerance: float) -> np.ndarray:
    """The least (side -1) or greatest (side 1) double c with |m - c| / m <= tolerance in floating point, or -inf:
    the doubles around m * (1 +- tolerance) are tried (steps of at most half a unit in the last place)."""
    c0, out = m * (1 + side * tolerance), np.full(len(m), -np.inf)
    for i in range(-20, 21) if side > 0 else range(20, -21, -1):
        c = c0 + i * (m * 5e-17)
        out = np.where(np.abs(m - c) / m <= tolerance, c, out)
    return out


def matches(place: np.ndarray, way: np.ndarray, other: np.ndarray, at: np.ndarray, m: np.ndarray, legs: np.ndarray,
            span: int, width: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """For the rows ``legs``: how many rows of their ``place`` go the ``other`` way with ``at`` in [at, at + span] and an
    amount within the tolerance, and the row of the greatest amount (of these, the earliest; -1: none).

    ``at`` lies in [0, width)."""
    key = (place * 2 + way) * (width + span + 1) + at
    order = np.flatnonzero(~np.isnan(m))
    order = order[np.argsort(key[order], kind="stable")]
    key, want = key[order], (place[legs] * 2 + other[legs]) * (width + span + 1) + at[legs]
    lo, hi = np.searchsorted(key, want, "left"), np.searchsorted(key, want + span, "right")
    amounts, code = np.unique(m[order], return_inverse=True)
    with np.errstate(invalid="ignore", over="ignore"):
        least, most = (tolerated(m[legs], side, tolerance) for side in (-1, 1))
    to = count_below(code, lo, hi, np.searchsorted(amounts, most, "right"))
    n = to - count_below(code, lo, hi, np.searchsorted(amounts, least, "left"))
    n = np.where(np.isnan(m[legs]), 0, n)
    best, some = np.full(len(legs), -1), np.flatnonzero(n > 0)
    found, _ = nth_smallest(code, lo[some], hi[some], to[some] - 1)
    by_code = np.argsort(code, kind="stable")
    first = np.searchsorted(code[by_code] * (len(code) + 1) + by_code, found * (len(code) + 1) + lo[some])
    best[some] = order[by_code[first]]
    return n, best


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row begins a new place."""
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for k in keys:
        codes = rows.column(k).combine_chunks().dictionary_encode()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def blocks(batches: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole places of rows sorted by ``keys``, about ``size`` rows at a time, with the number of each row's place."""
    held, n, most = [], 0, size
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= most:
            rows = pa.Table.from_batches(held)
            new = _starts(rows, keys)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield rows.slice(0, last), np.cumsum(new[:last])
                rows = rows.slice(last)
            held, n = rows.to_batches(), rows.num_rows
            most = max(size, 2 * n)
    if n:
        rows = pa.Table.from_batches(held)
        yield rows, np.cumsum(_starts(rows, keys))


def counter(keys: list[str], by: list[str], span: int, width: int, tolerance: float, names: list[str], size: int = BLOCK):
    """A task over rows (by, p, q, stretch, up, own, step, m, row_id) sorted by ``keys``: the rows that are ``own`` and
    have a match."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, place in blocks((b for b in batches if b.num_rows), keys, size):
            def of(name: str) -> np.ndarray:
                return rows.column(name).to_numpy()

            up, step = of("up").astype(bool), of("step").astype(np.int64)
            self_paid = pc.equal(rows.column("p"), rows.column("q")).to_numpy().astype(bool)
            n, best = matches(place, up.astype(np.int64), np.where(self_paid, up, ~up).astype(np.int64),
                              step - of("stretch").astype(np.int64) * width, of("m").astype(np.float64),
                              legs := np.flatnonzero(of("own").astype(bool)), span, width + span, tolerance)
            hit = np.flatnonzero(n > 0)
            if not len(hit):
                continue
            out, match = rows.take(pa.array(legs[hit])), rows.take(pa.array(best[hit]))
            p, q, way = out.column("p"), out.column("q"), out.column("up")
            cols = [*[out.column(c) for c in by], out.column("row_id"), pc.if_else(way, p, q), pc.if_else(way, q, p), out.column("step"),
                    out.column("m"), pa.chunked_array([pa.array(n[hit], pa.int64())]), match.column("m"),
                    pc.cast(match.column("step"), pa.int64())]
            yield from pa.Table.from_arrays(cols, names).combine_chunks().to_batches(max_chunksize=1 << 14)
    return run
