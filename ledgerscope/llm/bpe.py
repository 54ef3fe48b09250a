"""Byte-pair encoding of many words at once, in numpy.

Every step of byte-pair encoding merges the leftmost pair of lowest rank and makes a word one
symbol shorter.  So words are worked off by length, from the longest down: all words of m
symbols take one step together and join those of m - 1 symbols, until no pair of theirs is in
the merge table.  Results equal the reference algorithm's (the tests compare them).
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


class PairTable:
    """(left, right) -> rank.  Keys that collide in one hash level go to the next, smaller one."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        ranks = np.arange(len(keys), dtype=np.int32)
        self.levels = []
        bits = max(10, int(len(keys)).bit_length() + 2)
        for mult in _MULTIPLIERS:
            if not len(keys):
                break
            slot = self._slot(keys, mult, bits)
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << bits, 2**64 - 1, np.uint64)
            value = np.full(1 << bits, NONE, np.int32)
            table[slot[first]], value[slot[first]] = keys[first], ranks[first]
            self.levels.append((mult, bits, table, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, bits = keys[rest], ranks[rest], max(10, bits - 2)
        if len(keys):
            raise ValueError("merge table: too many collisions")

    @staticmethod
    def _slot(keys: np.ndarray, mult: int, bits: int) -> np.ndarray:
        return ((keys * np.uint64(mult)) >> np.uint64(64 - bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        out = np.full(keys.shape, NONE, np.int32)
        for mult, bits, table, value in self.levels:
            slot = self._slot(keys, mult, bits)
            out = np.where(table[slot] == keys, value[slot], out)
        return out


class BatchBpe:
    """Encoder of pre-tokenised words for a vocabulary with an end-of-word suffix."""

    #: Longer words (bytes) are left to the caller.
    LONGEST = 64

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.table = PairTable(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int32)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids (16-bit little-endian) of each word of 1 to LONGEST bytes."""
        n = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(n)
        sym[ends - 1] = self.final[flat[ends - 1]]
        out: list[bytes] = [b""] * len(words)
        rows = np.zeros(0, np.int64)
        s, r = np.zeros((0, 0), np.int32), np.zeros((0, 0), np.int32)
        for m in range(int(n.max(initial=0)), 0, -1):
            new = np.flatnonzero(n == m)
            if len(new):
                fresh = sym[(ends[new] - m)[:, None] + np.arange(m)]
                ranks = self.table.ranks(fresh[:, :-1], fresh[:, 1:])
                rows = np.concatenate([rows, new])
                s = np.concatenate([s, fresh]) if len(s) else fresh
                r = np.concatenate([r, ranks]) if len(r) else ranks
            if not len(rows):
                s, r = np.zeros((0, m - 1), np.int32), np.zeros((0, max(m - 2, 0)), np.int32)
                continue
            every = np.arange(len(rows))
            at = r.argmin(axis=1) if m > 1 else np.zeros(len(rows), np.int64)
            best = r[every, at] if m > 1 else np.full(len(rows), NONE)
            over = best == NONE
            if over.any():
                raw, width = s[over].astype("<u2").tobytes(), 2 * m
                for i, k in enumerate(rows[over].tolist()):
                    out[k] = raw[i * width:(i + 1) * width]
            go = ~over
            rows, s, r, at, best = rows[go], s[go], r[go], at[go], best[go]
            if m == 1 or not len(rows):
                s, r = s[:0, :max(m - 1, 0)], r[:0, :max(m - 2, 0)]
                continue
            every = np.arange(len(rows))
            s[every, at] = self.merged[best]
            keep = np.ones(s.shape, bool)
            keep[every, at + 1] = False
            s = s[keep].reshape(len(rows), m - 1)
            keep = np.ones(r.shape, bool)
            keep[every, at] = False
            r = r[keep].reshape(len(rows), m - 2)
            for shift in (-1, 0):          # the pairs that the merged symbol is in
                p = at + shift
                ok = (p >= 0) & (p < m - 2)
                i, p = every[ok], p[ok]
                r[i, p] = self.table.ranks(s[i, p], s[i, p + 1])
        return out
