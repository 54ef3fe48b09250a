"""MinHash near-duplicates: BagMinHash signatures, bands, exact multiset overlap, classes.

Texts are multisets of five-word shingles (lower-cased runs of letters and digits); shorter texts
have one shingle of all their words.  Two texts are linked when the weighted Jaccard similarity
of their multisets is at least ``threshold``; classes are the connected components.

1. Equal texts become one node (64-bit hash of the text).
2. Every node gets a signature of m = bands x rows components (``bagminhash``).  Two nodes are
   candidates when all rows of a band agree: at similarity 0.8 a pair is missed with probability
   (1 - 0.8^5)^25 = 5e-5.
3. Within a bucket no all-pairs list is made.  The bucket's most central member (the one that
   shares the most bucket seats) is its pivot, and every member is compared with it.
4. That leaves pairs of a bucket that the links so far don't connect.  They are joined under the
   condition that they are in different components and that the two-bit sketches of FINE further
   components agree as often as linked texts' do (``least_match``: an estimate of 0.75; a linked
   pair fails it with probability 2e-4, one of similarity 0.7 passes with 0.4 %), so only
   likely links come out of the join.
5. All candidate pairs are verified on the whole multisets (the k-th copy of a shingle is an
   element of its own, so the overlap of multisets is the overlap of sets).
6. Connected components by repeated minimum labels with shortcuts, checkpointed each round.

Profiles (the multisets) are only made for nodes of candidate pairs: a Bloom filter of their
representative rows is applied where the texts are read.

Defined cases: NULL text counts as empty; texts without a word are only like equal texts (so
all empty texts are one class).  The class id is the smallest non-NULL ``doc_id`` of the class
(NULL if there is none); it names a class, but where unrelated texts share a ``doc_id`` or ids are
NULL, only ``label`` (the smallest node) tells classes apart.  Repeated rows are in the same class
and all returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm import bagminhash
from ledgerscope.llm.common import checkpointed, ship_package, text_or_empty, tidy
from ledgerscope.llm.url_filter import bloom_blocks, possible_hits

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 25, 5, 0.8
FINE = 1024                                        # components of the sketches
SKETCH_LONGS = FINE // 32                          # thirty-two 2-bit values in a long
WORDS_AT_ONCE, DOCS_AT_ONCE = 150_000, 512
_P = np.uint64(0x100000001B3)
_LOW = np.uint64(52)                               # bits of a shingle's hash


def node_of(text: Column) -> Column:
    return F.xxhash64(text)


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""),
                       lambda w: F.xxhash64(w))


def shingles(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, 52-bit shingle) of every shingle, sorted by both; from word hashes of
    all documents in a row and the documents' offsets.  At most DOCS_AT_ONCE documents."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    rest = np.repeat(offsets[1:], n) - np.arange(offsets[0], offsets[0] + len(doc))   # words from here on
    first = rest == n[doc]
    w = bagminhash.mix(values.view(np.uint64))
    acc = np.zeros(len(w), np.uint64)
    for k in range(SHINGLE):
        inside = rest > k
        step = np.zeros(len(w), np.uint64)
        step[inside] = w[np.flatnonzero(inside) + k]
        acc = np.where(inside, acc * _P + step, acc)
    take = (rest >= SHINGLE) | (first & (n[doc] < SHINGLE))
    key = (doc[take].astype(np.uint64) << _LOW) | (bagminhash.mix(acc[take]) >> np.uint64(64 - 52))
    key.sort()
    return (key >> _LOW).astype(np.int64), key & np.uint64(2**52 - 1)


def multisets(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of the distinct sorted shingles."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return doc[at], shingle[at], np.diff(np.append(at, len(doc)))


def bands(sig: np.ndarray) -> np.ndarray:
    """[docs, BANDS] bucket hashes of signatures of BANDS x ROWS components."""
    bits = sig.view(np.uint64)
    band = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        band = bagminhash.mix(band ^ bits[:, r::ROWS])
    return bagminhash.mix(band + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """[docs, SKETCH_LONGS] packed 2-bit hashes of signatures of FINE components."""
    two = bagminhash.mix(sig.view(np.uint64)) >> np.uint64(62)
    out = np.zeros((len(sig), SKETCH_LONGS), np.uint64)
    for i in range(32):
        out |= two[:, i::32] << np.uint64(2 * i)
    return out.view(np.int64)


def _runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most DOCS_AT_ONCE documents and WORDS_AT_ONCE words (or one document)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + WORDS_AT_ONCE, "right")) - 1
        hi = min(max(hi, lo + 1), lo + DOCS_AT_ONCE, n)
        yield lo, hi
        lo = hi


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets from 0) of a list<int64> column without NULLs."""
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return values.to_numpy(zero_copy_only=False), (offsets - offsets[0]).astype(np.int64)


def _list_array(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int64)))


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, node, bands`` per row; texts without a word have no bands."""
    ship_package(docs.sparkSession)
    t = text_or_empty("text")
    src = docs.select("doc_id", node_of(t).alias("node"), word_hashes(t).alias("words"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("node", T.LongType()),
                           T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = _lists(b.column(2))
            for lo, hi in _runs(offsets):
                o = offsets[lo:hi + 1]
                d, s, c = multisets(*shingles(values[o[0]:o[-1]], o))
                sig = bagminhash.signatures(d, s, c, hi - lo, BANDS * ROWS)
                some = np.diff(o) > 0
                ends = np.concatenate([[0], np.cumsum(some)])
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo),
                    _list_array(bands(sig)[some].ravel(), ends * BANDS)], schema.names)

    return src.mapInArrow(tidy(run), schema)


def profiles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, items`` (distinct 64-bit (shingle, copy number) of the whole text) and ``sketch`` for
    the nodes of ``wanted`` (``node, doc_id`` of a representative row)."""
    spark = docs.sparkSession
    ship_package(spark)
    t = text_or_empty("text")
    rows = docs.select(node_of(t).alias("node"), t.alias("text"),
                       F.xxhash64(node_of(t), "doc_id").alias("row"))
    keys = wanted.select("node", F.xxhash64("node", "doc_id").alias("row"))
    n_blocks = max(1, math.ceil(keys.count() / 32))
    near = possible_hits(rows, "row", bloom_blocks(keys, "row", n_blocks), n_blocks)
    src = near.select("node", "row", word_hashes(F.col("text")).alias("words"))
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("row", T.LongType()),
                           T.StructField("items", T.ArrayType(T.LongType(), False)),
                           T.StructField("sketch", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = _lists(b.column(2))
            for lo, hi in _runs(offsets):
                o = offsets[lo:hi + 1]
                d, s, c = multisets(*shingles(values[o[0]:o[-1]], o))
                item = np.repeat(s, c)
                copy = np.arange(len(item)) - np.repeat(np.cumsum(c) - c, c)
                item = bagminhash.mix(item + copy.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                n = np.bincount(np.repeat(d, c), minlength=hi - lo)
                # a seed of its own, so the sketch is independent of the bands
                sig = bagminhash.signatures(d, bagminhash.mix(s), c, hi - lo, FINE)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo),
                    _list_array(item.view(np.int64), np.concatenate([[0], np.cumsum(n)])),
                    _list_array(sketches(sig).ravel(), np.arange(hi - lo + 1) * SKETCH_LONGS)], schema.names)

    made = src.mapInArrow(tidy(run), schema).dropDuplicates(["node", "row"])
    return made.join(keys, ["node", "row"]).select("node", "items", "sketch")


def verified(pairs: DataFrame, profile: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` of the pairs whose multisets overlap enough."""
    pa_ = profile.select(F.col("node").alias("a"), F.col("items").alias("_x"))
    pb = profile.select(F.col("node").alias("b"), F.col("items").alias("_y"))
    j = pairs.select("a", "b").join(pa_, "a").join(pb, "b")
    both = F.size(F.array_intersect("_x", "_y"))
    sim = both / (F.size("_x") + F.size("_y") - both)
    return j.select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= threshold)


def matching_components() -> Column:
    """Number of sketch components whose two bits agree, from the columns ``_s0.. , _t0..``."""
    # a pair of bits of a ^ b is zero where the values agree: fold it into its lower bit
    ones = F.lit(0x5555555555555555).cast("long")
    total = F.lit(0)
    for i in range(SKETCH_LONGS):
        x = F.col(f"_s{i}").bitwiseXOR(F.col(f"_t{i}"))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones))
    return F.lit(FINE) - total


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``node, label``: the smallest node of each connected component of the edges (a, b).

    Rounds of "take the smallest label of your neighbours, then your label's label"; each round
    is checkpointed, so lineage stays short and lost executors cost one round.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                        .distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m"))
                          .select("node", F.least("node", "_m").alias("label")))
    for _ in range(most_rounds):
        low = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
               .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_n")))
        new = labels.join(low, "node").select("node", "label", F.least("label", "_n").alias("_n"))
        hop = labels.select(F.col("node").alias("_n"), F.col("label").alias("_h"))
        new = checkpointed(new.join(hop, "_n").select("node", F.least("_n", "_h").alias("_l"), "label"))
        changed = new.where(F.col("_l") != F.col("label")).limit(1).count()
        labels = new.select("node", F.col("_l").alias("label"))
        if not changed:
            return labels
    raise RuntimeError("components: too many rounds")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, least_match: float = 0.81) -> DataFrame:
    """Every row's ``doc_id``, ``node`` (hash of its text), ``class_id`` and ``label`` of its class.

    Bands and sketches are made for THRESHOLD and would miss pairs of a lower one."""
    if threshold < THRESHOLD:
        raise ValueError(f"threshold must be at least {THRESHOLD}")
    rows = checkpointed(signed(docs))
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    seats = nodes.select("node", F.explode("bands").alias("h"))
    sizes = seats.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    live = checkpointed(seats.join(sizes, "h"))              # buckets with two nodes or more
    central = live.groupBy("node").agg(F.sum("c").alias("seats"))
    pivots = (live.join(central, "node").groupBy("h")
              .agg(F.max(F.struct("seats", "node"))["node"].alias("pivot")))
    spokes = (live.select("h", "node").join(pivots, "h").where(F.col("node") != F.col("pivot"))
              .select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct())
    used = live.select("node").distinct()
    wanted = checkpointed(nodes.join(used, "node", "left_semi"))
    profile = checkpointed(profiles(docs, wanted))
    first = checkpointed(verified(spokes, profile, threshold).select("a", "b"))

    # pairs of a bucket in different components so far
    linked = components(first)
    part = live.select("h", "node").join(linked, "node", "left").select(
        "h", "node", F.coalesce("label", "node").alias("part"))
    mixed = (part.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
             .where(F.col("lo") != F.col("hi")).select("h"))
    sketch = profile.select("node", *[F.get("sketch", F.lit(i)).alias(f"_s{i}") for i in range(SKETCH_LONGS)])
    left = (checkpointed(part.join(mixed, "h", "left_semi")).join(sketch, "node")
            .join(wanted.select("node", F.col("bands").alias("_bands")), "node"))
    right = left.select("h", F.col("node").alias("b"), F.col("part").alias("_part"),
                        F.col("_bands").alias("_other"),
                        *[F.col(f"_s{i}").alias(f"_t{i}") for i in range(SKETCH_LONGS)])
    rest = (left.withColumnRenamed("node", "a")
            .join(right, "h").where((F.col("a") < F.col("b")) & (F.col("part") != F.col("_part"))
                                    & (matching_components() >= int(least_match * FINE))
                                    # a pair comes out of its first common band only
                                    & (F.get(F.array_intersect("_bands", "_other"), F.lit(0)) == F.col("h")))
            .select("a", "b"))
    second = verified(rest, profile, threshold).select("a", "b")
    labels = components(first.unionByName(second))
    known = rows.select("doc_id", "node").join(labels, "node", "left").select(
        "doc_id", "node", F.coalesce("label", "node").alias("label"))
    known = checkpointed(known)
    ids = known.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return known.join(ids, "label").select("doc_id", "node", "class_id", "label")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with one document of each class: a row whose id is the class id
    (a row of the class if no id is known), the one with the smallest text hash."""
    found = near_duplicates(docs, **options)
    best = (found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label", "class_id")
            .agg(F.min("node").alias("_node"))
            .select(F.xxhash64("_node", "class_id").alias("_row"), "_node"))
    # the row travels as one struct, so its columns can't clash with the keys
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), node_of(text_or_empty("text")).alias("_node"))
    rows = rows.withColumn("_row", F.xxhash64("_node", "_doc.doc_id"))
    return rows.join(best, ["_row", "_node"], "left_semi").dropDuplicates(["_row", "_node"]).select("_doc.*")
