"""Alignment of the tokens of two tokenizers, with corpus-wide counts of the aligned pairs.

Tokenizer A is a byte-level vocabulary, B a piece model with byte fallback; both read space + text.
Byte offsets where a token of A and one of B end cut the two token rows into groups; an A-B pair of
occurrences whose byte ranges overlap is a link, and the count of an id pair is the number of
documents that hold it linked.

Units.  Between two ordinary characters a single space or line end begins a new token in A (its
splitting rule) and in B (no piece goes on after one; checked when the model is loaded).  So a text is
cut there into units, each distinct unit of a block is encoded once, many in one call, and everything
about a document is a sum or a concatenation over its units.

Passes, each over blocks of documents and without a shuffle of texts or tokens:

1. Encode; the token ids of the distinct units and the unit numbers of the documents are written
   to the shared folder, so later passes need no tokenizer and a lost executor costs one task.
2. Distinct linked pairs, spread by hash over shards; each shard builds a minimal perfect hash of
   its pairs (bit arrays in which only pairs without a collision set a bit; the rest goes on to
   the next one; a pair's slot is the rank of its bit).
3. Each task counts its documents in a dense vector indexed by slot; the vectors are summed in two steps
   (tree), shard by shard.
4. The documents are aligned again and look their counts up; a pair's key at its slot is verified.

The table of pairs (keys, bits, counts) goes to the tasks in slices of at most ``PAIRS_AT_ONCE`` pairs,
whose total is limited by the product of the vocabularies; a larger table takes more slices, each
adding its part to the documents' sums.

Defined cases: NULL and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no
tokens: zeros and no groups.  Repeated rows are documents of their own, NULL keys included; an
empty table gives no rows.  A text is held whole by its task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.bpe import byte_symbols
from ledgerscope.llm.common import checkpointed, shared_folder, ship_package, tidy
from ledgerscope.llm.words import bytes_of, large_binary, pieces

#: Text bytes of a block, unit bytes of one call, group text of an output batch.
BLOCK_BYTES, CALL_BYTES, OUT_BYTES = 5_000_000, 8_000, 4_000_000
#: Pairs of a shard, and pairs that a task holds at once.
SHARD_PAIRS, PAIRS_AT_ONCE = 16_384, 4_000_000
#: Links of a block that are counted at once, and pairs that a task gathers before it sends them on.
LINKS_AT_ONCE, SEEN_PAIRS = 1 << 18, 1_000_000
_LEAD = " a"                                   # a unit before those of a call

# Bytes next to which a space or line end begins a unit: ASCII marks, and U+00C0 to U+027F.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_FIRST = _PLAIN.copy()
_FIRST[0xC3:0xCA] = True


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        raw = {c: b for b, c in enumerate(byte_symbols())}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes(raw[c] for c in entry) if all(c in raw for c in entry) else entry.encode()
        self.b_bytes = []
        plain = True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
                continue
            self.b_bytes.append(piece.replace("▁", " ").encode())
            plain &= "▁" not in piece.lstrip("▁") and "\n" not in piece
        self.cut = plain                       # else whole texts are the units
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("token ids above 65,535")

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def encode(self, raw: bytes, lead: bool) -> tuple[list[int], list[int]] | None:
        """Ids of A and B for bytes that begin with a space, or with any unit if ``lead``; None
        if a tokenizer changes the bytes."""
        text = raw.decode("utf-8", "surrogatepass")
        head = _LEAD if lead else ""
        a = self.a.encode(head + text, add_special_tokens=False).ids
        b = self.b.encode((head + text)[1:])
        whole = head.encode() + raw
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        return a, b


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """Loaded once in each Python worker."""
    if (path_a, path_b) not in _LOADED:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _LOADED[path_a, path_b] = Tokenizers(path_a, path_b)
    return _LOADED[path_a, path_b]


def cut_units(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Ascending starts of the units of texts that begin at ``begins``."""
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[(at >= 2) & (at + 1 < len(data))]
    two = (data[at - 1] >= 0x80) & (data[at - 1] < 0xC0) & (data[at - 2] >= 0xC3) & (data[at - 2] < 0xCA)
    at = at[(_PLAIN[data[at - 1]] | two) & _FIRST[data[at + 1]]]
    return np.union1d(at, begins)


def joinable(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Units that can stand between any other units: both their ends are ordinary."""
    last = np.maximum(ends - 1, 0)
    two = (data[last] >= 0x80) & (data[last] < 0xC0) & (data[last - 1] >= 0xC3) & (data[last - 1] < 0xCA)
    long = ends - starts >= 2
    second = np.minimum(starts + 1, ends - 1)
    return long & _FIRST[data[second]] & (_PLAIN[data[last]] | two)


class Tokens:
    """Token ids of units, one after another: ``ids`` and the number of ids of each unit."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray, skip: int) -> bool:
        """Add the ids of units that end at ``ends``; the first ``skip`` bytes don't count."""
        at = np.searchsorted(reach := np.cumsum(lengths[ids]) - skip, np.concatenate([[0], ends]))
        if skip == 0:
            at[0] = -1
        if (reach[at[1:]] != ends).any() or skip and reach[at[0]] != 0:
            return False
        self.ids.append(ids[at[0] + 1:])
        self.counts.append(np.diff(at))
        return True


def encode_units(tok: Tokenizers, units: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(ids of A and B, their numbers per unit of A and B, units that don't come back)."""
    data, off = bytes_of(units)
    starts, ends = off[:-1], off[1:]
    rows = joinable(data, starts, ends) if tok.cut and len(units) else np.zeros(len(units), bool)
    raw = data.tobytes()
    la, lb = tok.lengths()
    out = (Tokens(), Tokens())
    bad = np.zeros(len(units), bool)

    def call(lo: int, hi: int) -> None:
        first_ok = len(raw) > starts[lo] + 1 and bool(_FIRST[raw[starts[lo] + 1]]) and ends[lo] - starts[lo] > 1
        lead = tok.cut and (first_ok or raw[starts[lo]] != 0x20)
        got = tok.encode(raw[starts[lo]:ends[hi - 1]], lead)
        if got is not None:
            skip = len(_LEAD) if lead else 0
            rel = ends[lo:hi] - starts[lo]
            kept = [len(t.ids) for t in out]
            done = [t.add(np.array(ids, np.int64), n, rel, skip) for t, ids, n in zip(out, got, (la, lb), strict=True)]
            if all(done):
                return
            for t, n in zip(out, kept, strict=True):
                del t.ids[n:], t.counts[n:]
        if hi - lo > 1:
            mid = (lo + hi) // 2
            call(lo, mid)
            call(mid, hi)
        else:
            bad[lo] = True
            for t in out:
                t.ids.append(np.zeros(0, np.int64))
                t.counts.append(np.zeros(1, np.int64))

    lo = 0
    odd = np.append(np.flatnonzero(~rows), len(units))
    while lo < len(units):
        stop = int(odd[np.searchsorted(odd, lo)])        # joinable units up to here
        hi = lo + 1 if stop == lo else min(stop, max(lo + 1, int(np.searchsorted(ends, starts[lo] + CALL_BYTES))))
        call(lo, hi)
        lo = hi
    none = [np.zeros(0, np.int64)]
    return [np.concatenate(t.ids or none) for t in out], [np.concatenate(t.counts or none) for t in out], bad


#: One row per block: keys, units per document, unit numbers, ids and their numbers per unit, and
#: units without tokens.
_BINARY = ["units", "codes", "a_ids", "a_counts", "b_ids", "b_counts", "bad"]
_KINDS = dict(zip(_BINARY, ["<u4", "<u4", "<u2", "<u4", "<u2", "<u4", "?"], strict=True))


def encode_block(tok: Tokenizers, texts: pa.Array) -> dict[str, bytes]:
    col = pc.fill_null(texts.cast(pa.large_binary()), b"")
    some = pc.binary_length(col).to_numpy(zero_copy_only=False) > 0
    space = pa.scalar(b" ", pa.large_binary())
    data, off = bytes_of(pc.binary_join_element_wise(space, col.filter(pa.array(some)), pa.scalar(b"", pa.large_binary())))
    starts = cut_units(data, off[:-1]) if tok.cut else off[:-1]
    units = np.zeros(len(texts), np.int64)
    units[some] = np.diff(np.searchsorted(starts, off))
    names = large_binary(data, np.append(starts[1:], len(data))[:len(starts)]).dictionary_encode()
    ids, counts, bad = encode_units(tok, names.dictionary)
    values = [units, names.indices.to_numpy(zero_copy_only=False), ids[0], counts[0], ids[1], counts[1], bad]
    return {n: np.asarray(v).astype(_KINDS[n]).tobytes() for n, v in zip(_BINARY, values, strict=True)}


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - first, count)


class Aligned:
    """The alignment of a written block."""

    def __init__(self, row: dict, la: np.ndarray, lb: np.ndarray):
        v = {n: np.frombuffer(row[n], k) for n, k in _KINDS.items()}
        self.codes, units = v["codes"].astype(np.int64), v["units"].astype(np.int64)
        self.n_docs = len(units)
        self.doc = np.repeat(np.arange(self.n_docs), units)
        lost = np.zeros(self.n_docs, bool)
        lost[self.doc[v["bad"][self.codes]]] = True
        if lost.any():                                   # no tokens at all
            self.codes, self.doc = self.codes[~lost[self.doc]], self.doc[~lost[self.doc]]
        self.a, self.b = v["a_ids"].astype(np.int64), v["b_ids"].astype(np.int64)
        self.n_a, self.n_b = v["a_counts"].astype(np.int64), v["b_counts"].astype(np.int64)
        reach_a, reach_b = np.cumsum(la[self.a]), np.cumsum(lb[self.b])
        lo = np.searchsorted(reach_b, reach_a - la[self.a], "right")
        hi = np.searchsorted(reach_b, reach_a, "left")
        per_a = hi - lo + 1
        self.link_a = np.repeat(self.a, per_a)
        self.pairs = (self.link_a << 16) | self.b[_ranges(lo, per_a)]
        unit_a = np.repeat(np.arange(len(self.n_a)), self.n_a)
        self.n_links = np.bincount(unit_a, per_a, len(self.n_a)).astype(np.int64)
        self.cut_a = reach_b[hi] == reach_a if len(hi) else np.zeros(0, bool)
        at = np.searchsorted(reach_a, reach_b)
        self.cut_b = reach_a[at] == reach_b if len(at) else np.zeros(0, bool)
        self.n_groups = np.bincount(unit_a, self.cut_a, len(self.n_a)).astype(np.int64)

    def per_doc(self, per_unit: np.ndarray) -> np.ndarray:
        """Sums over the documents' units."""
        total = np.concatenate([[0], np.cumsum(per_unit[self.codes])])
        return np.diff(total[np.searchsorted(self.doc, np.arange(self.n_docs + 1))])

    def per_unit(self, per_link: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(per_link)])[np.concatenate([[0], np.cumsum(self.n_links)])])

    def add_pairs_of_docs(self, slots: np.ndarray, total: np.ndarray) -> None:
        """Add to each slot's total the number of documents with a link of that slot (-1: none): some documents
        at a time, as many as have about ``LINKS_AT_ONCE`` links."""
        first = np.concatenate([[0], np.cumsum(self.n_links)])
        ends = np.concatenate([[0], np.cumsum(self.n_links[self.codes])])[np.searchsorted(self.doc, np.arange(self.n_docs + 1))]
        at, size = 0, len(total)
        while at < self.n_docs:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + LINKS_AT_ONCE, "right")) - 1)
            lo, hi = np.searchsorted(self.doc, [at, to])
            key = np.unique((self.doc[lo:hi] - at) * len(self.n_links) + self.codes[lo:hi])
            doc, unit = np.divmod(key, max(1, len(self.n_links)))
            slot = slots[_ranges(first[unit], self.n_links[unit])]
            doc = np.repeat(doc, self.n_links[unit])
            slot, count = np.unique(np.unique((doc * size + slot)[slot >= 0]) % max(1, size), return_counts=True)
            total[slot] += count.astype(total.dtype)
            at = to

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(text of the units' groups, ends of the units): ``a1,a2|b1;`` and so on."""
        group_a = np.cumsum(self.cut_a) - self.cut_a
        group_b = np.cumsum(self.cut_b) - self.cut_b
        place = np.concatenate([np.arange(len(self.a)) + np.searchsorted(group_b, group_a, "left"),
                                np.arange(len(self.b)) + np.searchsorted(group_a, group_b, "right")])
        mark = np.concatenate([np.where(self.cut_a, 1, 0), np.where(self.cut_b, 2, 0)])
        index = np.empty(len(place), np.int64)
        index[place] = np.concatenate([self.a, self.b]) * 3 + mark
        data, off = bytes_of(_numerals().take(pa.array(index)))
        return data, off[np.cumsum(self.n_a + self.n_b)]


_NUMERALS: list[pa.Array] = []


def _numerals() -> pa.Array:
    """The decimal ids, each with one of the three marks behind it."""
    if not _NUMERALS:
        _NUMERALS.append(pa.array([f"{i}{m}".encode() for i in range(1 << 16) for m in ",|;"], pa.large_binary()))
    return _NUMERALS[0]


# ------------------------------------------------------------------ minimal perfect hashing
def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash function of distinct keys."""
    out = []
    while len(keys):
        size = 2 * len(keys) + 6
        at = (_hash(keys, len(out)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        out.append(alone)
        keys = keys[~alone[at]]
    return out


def slots_of(keys: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """Slots of keys; -1 for some keys that weren't hashed (others get any slot)."""
    slot, base = np.full(len(keys), -1, np.int64), 0
    todo = np.arange(len(keys))
    for level, alone in enumerate(bits):
        at = (_hash(keys[todo], level) % np.uint64(len(alone))).astype(np.int64)
        hit = alone[at]
        slot[todo[hit]] = base + (np.cumsum(alone) - 1)[at[hit]]
        todo = todo[~hit]
        base += int(alone.sum())
    return slot


class PairTable:
    """Some shards of the pair table: slot of a pair, its verified key, its count.  Bits, keys and counts stay as
    they were sent; a shard's bits are unpacked for a lookup only."""

    def __init__(self, rows: list, shards: int):
        self.shards = shards
        self.rows = {r["shard"]: (r["bits"], r["sizes"], np.frombuffer(r["keys"], "<u4")) for r in rows}
        self.counts = {r["shard"]: np.frombuffer(r["counts"], "<u4" if len(r["counts"]) == len(r["keys"]) else "<i8")
                       for r in rows if r["counts"] is not None}
        sizes = [len(self.rows[s][2]) for s in self.rows]
        self.base = dict(zip(self.rows, np.cumsum([0, *sizes]).tolist(), strict=False))
        self.size = sum(sizes)

    def found(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots of pairs; -1 for pairs of other shards, their counts or 0).  A wrong key is an error."""
        distinct, of = np.unique(pairs, return_inverse=True)
        out, count = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        shard = shard_of(distinct, self.shards)
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-2))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            s = int(shard[order[lo]])
            if s in self.rows:
                bits, lengths, keys = self.rows[s]
                bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(bits, lengths, strict=True)]
                slot = slots_of(distinct[order[lo:hi]], bits)
                if (slot < 0).any() or (keys[slot] != distinct[order[lo:hi]]).any():
                    raise ValueError("a pair isn't in the table of its shard")
                out[order[lo:hi]] = slot + self.base[s]
                if s in self.counts:
                    count[order[lo:hi]] = self.counts[s][slot]
        return out[of], count[of]

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        return self.found(pairs)[0]


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (_hash(pairs, 63) % np.uint64(shards)).astype(np.int64)


def _build_shard(group: pa.Table) -> pa.Table:
    keys = np.sort(group.column("pair").to_numpy())
    bits = build_hash(keys)
    by_slot = np.empty(len(keys), np.int64)
    by_slot[slots_of(keys, bits)] = keys
    return pa.table({"shard": group.column("shard").slice(0, 1), "n": pa.array([len(keys)], pa.int64()),
                     "bits": pa.array([[np.packbits(b).tobytes() for b in bits]], pa.list_(pa.binary())),
                     "sizes": pa.array([[len(b) for b in bits]], pa.list_(pa.int64())),
                     "keys": pa.array([by_slot.astype("<u4").tobytes()], pa.binary())})


def _sum_vectors(group: pa.Table, kind: str = "<i8") -> pa.Table:
    total = np.zeros(0, np.int64)
    for v in group.column("counts"):
        one = np.frombuffer(v.as_buffer(), kind)
        total = total + one if len(total) else one.astype(np.int64)
    return pa.table({"shard": group.column("shard").slice(0, 1), "part": group.column("part").slice(0, 1),
                     "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Highest count of each A id among a batch of shards."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.concatenate([np.frombuffer(k, "<u4") for k in b.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(c, "<i8") for c in b.column("counts").to_pylist()])
        best = np.zeros(1 << 16, np.int64)
        np.maximum.at(best, keys >> 16, counts)
        a = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(best[a], pa.int64())], ["a", "best"])


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Alignment:
    """Aligned documents: ``pairs`` (distinct pairs with their counts, by shard) and ``documents``."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text",
                 paths: tuple[str, str] | None = None, pairs_at_once: int = PAIRS_AT_ONCE):
        spark = docs.sparkSession
        ship_package(spark)
        self.key, self.spark = key, spark
        self.paths = paths or default_tokenizers()
        self.lengths = Tokenizers(*self.paths).lengths()
        self.blocks = self._encoded(docs, text)
        self.table, self.slices = self._pair_table(pairs_at_once)

    def _encoded(self, docs: DataFrame, text: str) -> DataFrame:
        src = docs.select(F.col(self.key).alias(self.key), F.col(text).cast("string").alias("_text"))
        paths = self.paths
        schema = T.StructType([T.StructField("_keys", T.ArrayType(src.schema[self.key].dataType)),
                               *[T.StructField(n, T.BinaryType()) for n in _BINARY]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tok = tokenizers(*paths)
            for b in batches:
                for i, j in pieces(b.column(1), BLOCK_BYTES):
                    block = encode_block(tok, b.column(1).slice(i, j - i))
                    keys = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0).slice(i, j - i))
                    yield pa.RecordBatch.from_arrays(
                        [keys, *[pa.array([block[n]], pa.binary()) for n in _BINARY]], schema.names)

        folder = shared_folder(self.spark, "aligned")
        # a block is some MB: with one to a row group, neither writer nor reader holds all of a file
        src.mapInArrow(tidy(run), schema).write.option("compression", "zstd").option("parquet.block.row.count.limit", 1).parquet(folder)
        return self.spark.read.schema(schema).parquet(folder)

    def _rows(self):
        """A function that yields the aligned blocks of record batches with their rows."""
        la, lb = self.lengths

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Aligned, pa.RecordBatch]]:
            for b in batches:
                for i in range(b.num_rows):
                    one = b.slice(i, 1)
                    yield Aligned({n: one.column(n)[0].as_py() for n in _BINARY}, la, lb), one
        return rows

    def _pair_table(self, at_once: int) -> tuple[DataFrame, list]:
        rows = self._rows()

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(0, np.uint32)
            for block, _ in rows(batches):
                used = np.zeros(len(block.n_links), bool)
                used[block.codes] = True
                seen = np.union1d(seen, block.pairs[np.repeat(used, block.n_links)].astype(np.uint32))
                if len(seen) > SEEN_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64())], ["pair"])
                    seen = seen[:0]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64())], ["pair"])

        pairs = checkpointed(self.blocks.mapInArrow(tidy(distinct), "pair long").distinct())
        shards = max(1, -(-pairs.count() // SHARD_PAIRS))
        sharded = pairs.mapInArrow(_sharder(shards), "shard long, pair long")
        table = checkpointed(sharded.groupBy("shard").applyInArrow(
            _build_shard, "shard long, n long, bits array<binary>, sizes array<long>, keys binary"))
        plan, run, size = [], [], 0
        for s, n in sorted((r["shard"], r["n"]) for r in table.select("shard", "n").collect()):
            if run and size + n > at_once:
                plan.append(run)
                run, size = [], 0
            run.append(s)
            size += n
        plan.append(run)
        counts = None
        for part in plan:
            vectors = self.blocks.mapInArrow(tidy(self._counter(self._slice(table, part, shards))), "shard long, part long, counts binary")
            counts = vectors if counts is None else counts.unionByName(vectors)
        # the tree: some tasks' vectors, then the sums of these
        step = max(1, int(self.blocks.rdd.getNumPartitions() ** 0.5))
        schema = "shard long, part long, counts binary"
        first = counts.withColumn("part", F.pmod("part", F.lit(step))).groupBy("shard", "part").applyInArrow(lambda g: _sum_vectors(g, "<u4"), schema)
        total = first.groupBy("shard").applyInArrow(lambda g: _sum_vectors(g), schema)
        table = checkpointed(table.join(total.drop("part"), "shard"))
        return table, [self._slice(table, part, shards) for part in plan]

    def _slice(self, table: DataFrame, part: list[int], shards: int):
        """A broadcast of the shards of one slice (at most ``pairs_at_once`` pairs, or one shard)."""
        def short(counts: bytes) -> bytes:
            wide = np.frombuffer(counts, "<i8")
            return wide.astype("<u4").tobytes() if wide.max(initial=0) < 1 << 32 else bytes(counts)

        some = table.where(F.col("shard").between(part[0], part[-1])) if part else table.limit(0)
        rows = [{"shard": r["shard"], "bits": r["bits"], "sizes": r["sizes"], "keys": r["keys"],
                 "counts": short(r["counts"]) if "counts" in table.columns else None} for r in some.collect()]
        return self.spark.sparkContext.broadcast((rows, shards))

    def _counter(self, piece):
        rows = self._rows()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = PairTable(*piece.value)
            total = np.zeros(table.size, np.uint32)               # documents of one task
            for block, _ in rows(batches):
                block.add_pairs_of_docs(table.slots(block.pairs), total)
            part = TaskContext.get().partitionId()
            for s, at in table.base.items():
                own = total[at:at + len(table.rows[s][2])]
                if own.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int64()), pa.array([part], pa.int64()),
                         pa.array([own.astype("<u4").tobytes()], pa.binary())], ["shard", "part", "counts"])
        return count

    def pairs(self) -> DataFrame:
        """Every linked id pair: ``a``, ``b``, ``documents``."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    keys = np.frombuffer(k, "<u4").astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys >> 16), pa.array(keys & 0xFFFF),
                                                      pa.array(np.frombuffer(c, "<i8"))], ["a", "b", "documents"])
        return self.table.select("keys", "counts").mapInArrow(run, "a long, b long, documents long")

    def documents(self) -> DataFrame:
        """Per document ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
        ``count_sum`` and ``groups`` (``a1,a2|b1;a3|b2,b3``)."""
        rows, key = self._rows(), self.key
        best = np.zeros(1 << 16, np.int64)      # one entry per A id
        for r in self.table.select("keys", "counts").mapInArrow(_best, "a long, best long").groupBy("a").agg(
                F.max("best").alias("best")).collect():
            best[r["a"]] = r["best"]
        tops = self.spark.sparkContext.broadcast(best)
        frame = self.blocks.withColumn("n_best", F.lit(b"")).withColumn("count_sum", F.lit(b""))

        def sums(block: Aligned, table: PairTable, one: pa.RecordBatch) -> list[np.ndarray]:
            slot, count = table.found(block.pairs)
            links = [(slot >= 0) & (count == tops.value[block.link_a]), count]
            out = []
            for name, x in zip(("n_best", "count_sum"), links, strict=True):
                before = np.frombuffer(one.column(name)[0].as_py(), "<i8")
                now = block.per_doc(block.per_unit(x.astype(np.int64)))
                out.append(now + before if len(before) else now)
            return out

        def adder(piece):
            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                table = PairTable(*piece.value)
                for block, one in rows(batches):
                    new = [pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in sums(block, table, one)]
                    yield pa.RecordBatch.from_arrays([*one.columns[:-2], *new], one.schema.names)
            return add

        for piece in self.slices[:-1]:
            frame = frame.mapInArrow(tidy(adder(piece)), frame.schema)
        last = self.slices[-1]
        names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
        keys = self.blocks.schema["_keys"].dataType.elementType
        schema = T.StructType([T.StructField(key, keys), *[T.StructField(n, T.LongType()) for n in names],
                               T.StructField("groups", T.StringType())])

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = PairTable(*last.value)
            for block, one in rows(batches):
                n_best, count_sum = sums(block, table, one)
                values = [block.per_doc(x) for x in (block.n_a, block.n_b, block.n_groups, block.n_links)]
                cols = [one.column("_keys").flatten(), *[pa.array(x, pa.int64()) for x in [*values, n_best, count_sum]]]
                data, ends = block.groups()
                texts = large_binary(data, ends)
                size = np.diff(ends, prepend=0)
                total = np.concatenate([[0], np.cumsum(size[block.codes])])
                ends = total[np.searchsorted(block.doc, np.arange(block.n_docs + 1))]
                at = 0
                while at < block.n_docs:
                    to = max(at + 1, int(np.searchsorted(ends, ends[at] + OUT_BYTES, "right")) - 1)
                    codes = block.codes[np.searchsorted(block.doc, at):np.searchsorted(block.doc, to)]
                    joined, _ = bytes_of(texts.take(pa.array(codes)))
                    inner = ends[at:to + 1] - ends[at]
                    some = np.diff(inner) > 0
                    keep = np.ones(len(joined), bool)
                    keep[inner[1:][some] - 1] = False          # the mark behind the last group
                    groups = large_binary(joined[keep], inner[1:] - np.cumsum(some)).cast(pa.large_string()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([*[c.slice(at, to - at) for c in cols], groups], schema.names)
                    at = to

        return frame.mapInArrow(tidy(finish), schema)


def _sharder(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(pairs, shards), pa.int64()), b.column(0)], ["shard", "pair"])
    return run


def alignment_summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    groups = F.col("groups")
    return found.select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256)).alias("groups_sha256"))
