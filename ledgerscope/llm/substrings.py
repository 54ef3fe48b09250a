"""Removal of passages that stand more than once in a corpus, by level-wise doubling.

A window of ``window`` words is repeated if its word sequence also starts anywhere else, in the
same document or another.  The lengths of the levels double up to the window (9, 18, 35):

* First level: each window is stood for by the short window inside it with the least hash (the
  leftmost of equal ones), so equal windows are stood for by equal short ones and about one
  position in fourteen is looked up.
* Windows whose short one is repeated are extended: to the window of twice the length that
  holds it and lies inside the full window; again only those that are repeated go on.
* At the last level the windows themselves are counted, and what repeated ones cover goes.

A level without survivors ends the search.  Nothing is sampled: a repeated window survives each
level, since everything that stands for it is a function of its words alone.

Data flow: the documents are written once, in blocks of some megabytes, as a table bucketed by block
in the shared folder, so that no later pass moves a text again.  A block sends each distinct
key of a level once, packed by key bucket; buckets answer with a bit per key.  So a passage
that stands in a third of all documents costs one key per block, and no task ever holds the rows
of a key, only its own bucket's.  Keys of the last level have 96 bits besides the bucket.

Defined cases: NULL and empty texts have no words; texts shorter than the window lose nothing; repeated
rows are documents of their own (so all their windows are repeated), NULL keys included; an empty
table gives no rows.  A text is held whole by the task that works on its block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.common import checkpointed, shared_folder, ship_package, tidy
from ledgerscope.llm.words import Words, pieces

#: Text bytes of a block, and blocks' worth of keys that a key bucket may hold.
BLOCK_BYTES, BLOCKS_PER_BUCKET = 4_000_000, 8
KEYS = "block long, level int, bucket int, n long, k1 binary, k2 binary, twice binary"
ANSWERS = "block long, level int, bucket int, n long, bits binary"


def chain(window: int) -> list[int]:
    """Lengths from one word to the window, each at most twice the one before."""
    out = [window]
    while out[-1] > 1:
        out.append(-(-out[-1] // 2))
    return out[::-1]


def levels(window: int, first: int) -> list[int]:
    return [n for n in chain(window) if n >= first] or [window]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(31)))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, window: int, wanted: list[int]) -> dict[int, np.ndarray]:
    """Hashes of all windows of the wanted lengths: each from two of the length before."""
    h, out, lengths = words, {}, chain(window)
    for before, n in zip([0, *lengths], lengths, strict=False):
        if before:
            step = n - before
            h = _mix(h[:-step], h[step:]) if len(h) > step else h[:0]
        if n in wanted:
            out[n] = h
    return out


def least_in_windows(v: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value among ``width`` values from each position on."""
    at, span = np.arange(len(v)), 1
    while span < width:
        step = min(span, width - span)
        if len(at) <= step:
            return at[:0]
        left, right = at[:-step], at[step:]
        at = np.where(v[left] <= v[right], left, right)
        span += step
    return at


class Block:
    """The words of some documents, and which of their windows are still in play."""

    def __init__(self, texts: pa.Array, window: int, first: int, buckets: int):
        self.words, self.window, self.buckets = Words(texts), window, buckets
        self.levels = levels(window, first)
        raw = b"".join(xxhash.xxh3_128_digest(w) for w in self.words.distinct.to_pylist())
        lanes = np.frombuffer(raw, "<u8").reshape(-1, 2).astype(np.uint64)
        codes = self.words.codes
        self.hashes = window_hashes(lanes[codes, 0], window, self.levels)
        self.check = window_hashes(lanes[codes, 1], window, [window])[window]
        left = np.repeat(self.words.doc_ends, np.diff(self.words.doc_ends, prepend=0)) - np.arange(len(codes))
        self.at = np.flatnonzero(left >= window)        # windows in play
        short = least_in_windows(self.hashes[self.levels[0]], window - self.levels[0] + 1)
        self.stand = short[self.at]                     # start of what stands for each
        self.level = 0

    def keys(self) -> tuple[np.ndarray, ...]:
        """(bucket, k1, k2, twice, number of each window's key) of the level's distinct keys."""
        n = self.levels[self.level]
        places, of = np.unique(self.stand, return_inverse=True)
        k1, k2 = self.hashes[n][places], np.zeros(len(places), np.uint32)
        if n == self.window:
            low = self.check[places]
            k2, bucket = (low >> np.uint64(32)).astype(np.uint32), (low & np.uint64(0xFFFFFFFF)) % np.uint64(self.buckets)
        else:
            bucket = (k1 >> np.uint64(20)) % np.uint64(self.buckets)
        order = np.lexsort((k2, k1, bucket))
        k1, k2, bucket = k1[order], k2[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(k1) != 0) | (np.diff(k2) != 0) | (np.diff(bucket) != 0)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        twice = np.bincount(number, minlength=int(new.sum())) > 1
        return bucket[new].astype(np.int64), k1[new], k2[new], twice, number[of]

    def narrow(self, bits: np.ndarray, number: np.ndarray) -> None:
        """Keep the windows whose key is repeated; extend what stands for them."""
        go = bits[number]
        self.at, self.stand = self.at[go], self.stand[go]
        self.level += 1
        if self.level < len(self.levels):
            self.stand = np.minimum(self.stand, self.at + (self.window - self.levels[self.level]))

    def replay(self, answers: pa.Table) -> None:
        """Apply the answers to all levels so far."""
        level = answers.column("level").to_numpy()
        bucket, bits = answers.column("bucket").to_numpy(), answers.column("bits").to_pylist()
        n = answers.column("n").to_numpy()
        for k in np.unique(level):
            rows = np.flatnonzero(level == k)
            rows = rows[np.argsort(bucket[rows])]
            flat = [np.unpackbits(np.frombuffer(bits[r], np.uint8), count=n[r]) for r in rows]
            self.narrow(np.concatenate(flat).astype(bool), self.keys()[4])

    def removed(self) -> np.ndarray:
        """Per word, whether a repeated window covers it."""
        cover = np.zeros(len(self.words.codes) + 1, np.int64)
        if self.level == len(self.levels):
            cover[self.at] += 1
            cover[self.at + self.window] -= 1
        return np.cumsum(cover[:-1]) > 0


def _blocked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``block``, key and ``_text``, written once and bucketed by block."""
    spark = docs.sparkSession
    src = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([T.StructField("_block", T.LongType()), *src.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for i, j in pieces(b.column(1), BLOCK_BYTES // 4):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(j - i, base + size // BLOCK_BYTES), pa.int64()), *part.columns], schema.names)
                size += part.column(1).nbytes

    name = f"word_blocks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    (src.mapInArrow(tidy(run), schema).write.format("parquet").bucketBy(parts, "_block")
     .option("path", shared_folder(spark, "word-blocks")).saveAsTable(name))
    return spark.table(name)


def _count(group: pa.Table) -> pa.Table:
    """The answers of one key bucket: which keys come from two places or more."""
    lengths = group.column("n").to_numpy()
    k1 = np.frombuffer(b"".join(group.column("k1").to_pylist()), "<u8")
    raw = b"".join(group.column("k2").to_pylist())
    k2 = np.frombuffer(raw, "<u4") if raw else np.zeros(len(k1), np.uint32)
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(
        group.column("twice").to_pylist(), lengths, strict=True)]).astype(bool)
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    again = twice[order]
    again[1:] |= same
    again[:-1] |= same
    # a key that one block already has twice comes from other blocks as well, or it stands alone
    found = np.empty(len(order), bool)
    found[order] = again
    ends = np.cumsum(lengths)
    bits = [np.packbits(found[e - n:e]).tobytes() for e, n in zip(ends, lengths, strict=True)]
    hits = pa.array(np.add.reduceat(found, ends - lengths) if len(ends) else [], pa.int64())
    return pa.table({"block": group.column("block"), "level": group.column("level"), "bucket": group.column("bucket"),
                     "n": group.column("n"), "bits": pa.array(bits, pa.binary()), "hits": hits})


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35,
                      first: int = 9) -> DataFrame:
    """Per document ``key``, ``n_words``, ``removed`` (array of start and length in words: what
    windows of ``window`` words cover that start elsewhere, too) and ``kept`` (the other words,
    joined by single spaces).  ``first``: least length of a level."""
    if window < 1 or first < 1:
        raise ValueError("lengths are at least one word")
    spark = docs.sparkSession
    ship_package(spark)
    blocks = _blocked(docs, key, text)
    n_blocks = blocks.select("_block").distinct().count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    buckets = max(parts, n_blocks // BLOCKS_PER_BUCKET)

    def block_of(group: pa.Table, answers: pa.Table) -> Block:
        block = Block(group.column("_text").combine_chunks(), window, first, buckets)
        block.replay(answers)
        return block

    def send(group: pa.Table, answers: pa.Table) -> pa.Table:
        block = block_of(group, answers)
        bucket, k1, k2, twice, _ = block.keys()
        used, start, n = np.unique(bucket, return_index=True, return_counts=True)
        last = block.levels[block.level] == window
        rows = [(k1[s:s + c].tobytes(), k2[s:s + c].tobytes() if last else b"", np.packbits(twice[s:s + c]).tobytes())
                for s, c in zip(start.tolist(), n.tolist(), strict=True)]
        binary = [pa.array([r[i] for r in rows], pa.binary()) for i in range(3)]
        return pa.table([pa.array(np.full(len(used), group.column("_block")[0].as_py()), pa.int64()),
                         pa.array(np.full(len(used), block.level), pa.int32()), pa.array(used, pa.int32()),
                         pa.array(n, pa.int64()), *binary], ["block", "level", "bucket", "n", "k1", "k2", "twice"])

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        block = block_of(group, answers)
        gone, w = block.removed(), block.words
        begins = np.zeros(len(gone) + 1, bool)
        begins[w.doc_starts] = True
        before = np.append(False, gone)[:-1]
        starts = np.flatnonzero(gone & (~before | begins[:-1]))
        stops = np.append(np.flatnonzero(~gone | begins[:-1]), len(gone))
        lengths = stops[np.searchsorted(stops, starts, "right")] - starts
        doc = np.searchsorted(w.doc_ends, starts, "right")
        spans = pa.StructArray.from_arrays([pa.array(starts - w.doc_starts[doc], pa.int64()), pa.array(lengths, pa.int64())],
                                           ["start", "length"])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=group.num_rows))])
        return pa.table([group.column(key), pa.array(np.diff(w.doc_ends, prepend=0), pa.int64()),
                         pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
                         w.joined(~gone).cast(pa.string())], [key, "n_words", "removed", "kept"])

    answers = spark.createDataFrame([], ANSWERS)
    for _ in levels(window, first):
        keys = blocks.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(send, KEYS)
        level = checkpointed(keys.groupBy("bucket").applyInArrow(_count, ANSWERS + ", hits long"))
        if not level.agg(F.sum("hits")).first()[0]:
            break
        answers = answers.unionByName(level.drop("hits"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    schema = T.StructType([blocks.schema[key], T.StructField("n_words", T.LongType()),
                           T.StructField("removed", T.ArrayType(span)), T.StructField("kept", T.StringType())])
    return blocks.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def removal_summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select(key, "n_words", gone.alias("n_removed"),
                        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
