"""Periodic runs of words: stretches in which a passage of ``period`` words stands several times.

Method: the dictionary of basic factors.  For the lengths L = 1, 2, 4, ... every position gets the
name of the L words from there on (a pair of names of the length before); only positions whose
factor stands again in the same text go on to the next length.  Occurrences of one factor inside a
span of 2 L lie in arithmetic progression, so positions in a row whose next occurrence is the
same distance d <= L away propose the period d.  Such a stretch is extended as far as words d
apart are the same, and the proposals of all lengths are deduplicated: one run per stretch, with its
smallest period.  A run with period q <= L and at least 3 L + q words is certain to be
proposed at the first L >= q (any factor of q or more words comes again after exactly q words inside it).

Everything is one pass over the documents without a shuffle: a text is one row, and its work is
O(n log n) in its words.  A very long text is held whole by its task.

Defined cases: NULL and empty texts have no words and no run; a NULL key stays NULL; repeated rows
are treated alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.common import ship_package, tidy
from ledgerscope.llm.words import Words, pieces

#: Text bytes worked on at once.
AT_ONCE = 8_000_000
WORD = r"[^\x20\x09-\x0D]+"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _stretches(at: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the maximal runs of consecutive positions with one step."""
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(step) != 0)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(at))[:len(first)] - 1


def _extended(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: np.ndarray, begin: np.ndarray,
              end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [lo, hi) grown inside their texts [begin, end) while words d apart are the same."""
    lo, hi = lo.copy(), hi.copy()
    grow = np.flatnonzero(lo > begin)
    while len(grow):
        grow = grow[codes[lo[grow] - 1] == codes[lo[grow] - 1 + d[grow]]]
        lo[grow] -= 1
        grow = grow[lo[grow] > begin[grow]]
    grow = np.flatnonzero(hi < end)
    while len(grow):
        grow = grow[codes[hi[grow]] == codes[hi[grow] - d[grow]]]
        hi[grow] += 1
        grow = grow[hi[grow] < end[grow]]
    return lo, hi


def find_runs(codes: np.ndarray, doc_ends: np.ndarray, times: int = 4, least: int = 6
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the texts that lie one after another in ``codes``,
    by start: at least ``least`` words and ``times`` (3 or more) periods."""
    n = len(codes)
    doc = np.repeat(np.arange(len(doc_ends)), np.diff(doc_ends, prepend=0))
    begins, ends = np.concatenate([np.zeros(1, np.int64), doc_ends[:-1]])[doc], doc_ends[doc]
    at = np.arange(n)                                 # positions still in play, ascending
    key = doc * (int(codes.max(initial=0)) + 1) + codes
    found = []
    length = 1
    while len(at):
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        same = sorted_key[1:] == sorted_key[:-1]
        step = np.zeros(len(at), np.int64)            # to the next occurrence; 0: none
        step[order[:-1][same]] = at[order[1:][same]] - at[order[:-1][same]]
        near = np.flatnonzero((step > 0) & (step <= length))
        first, last = _stretches(at[near], step[near])
        lo, d = at[near[first]], step[near[first]]
        hi = at[near[last]] + length + d
        enough = hi - lo >= 3 * d                     # three terms of the progression
        lo, hi, d = lo[enough], hi[enough], d[enough]
        lo, hi = _extended(codes, lo, hi, d, begins[lo], ends[lo])
        ok = hi - lo >= np.maximum(least, times * d)
        found.append(np.stack([lo[ok], hi[ok], d[ok]]))
        # names of the factors, then pairs of them for the next length
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        name = np.empty(len(at), np.int64)
        name[order] = np.concatenate([[0], np.cumsum(~same)]) if len(at) else 0
        at, name = at[again], name[again]
        right = np.searchsorted(at, at + length)
        ok = right < len(at)
        ok[ok] = at[right[ok]] == at[ok] + length
        ok &= at + 2 * length <= ends[at]
        key = name[ok] * (int(name.max(initial=0)) + 1) + name[right[ok]]
        at = at[ok]
        length *= 2
    lo, hi, d = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((d, hi, lo))
    lo, hi, d = lo[order], hi[order], d[order]
    once = np.ones(len(lo), bool)
    once[1:] = (np.diff(lo) != 0) | (np.diff(hi) != 0)   # the smallest period of a stretch
    lo, hi, d = lo[once], hi[once], d[once]
    order = np.lexsort((d, lo))
    return lo[order], hi[order], d[order]


def _block(texts: pa.Array, times: int, least: int) -> tuple[pa.Array, pa.Array]:
    """(runs, collapsed text) of each text."""
    w = Words(texts)
    lo, hi, d = find_runs(w.codes, w.doc_ends, times, least)
    doc = np.searchsorted(w.doc_ends, lo, "right")
    begin = w.doc_starts[doc]
    cover = np.zeros(len(w.codes) + 1, np.int64)
    np.add.at(cover, lo + d, 1)
    np.add.at(cover, hi, -1)
    keep = np.cumsum(cover[:-1]) == 0
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (lo - begin, hi - lo, d)], fields=list(_RUN))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), w.joined(keep)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = 4,
                  least: int = 6) -> DataFrame:
    """Per document ``key``, ``runs`` (array of start, length, period in words, by start, then
    period) and ``collapsed``: the text without the words that a run repeats (all
    after its first ``period`` words), joined by single spaces.

    A run is a stretch of at least ``least`` words and ``times`` times its smallest period that
    no neighbouring word extends.
    """
    if times < 4 or least < 1:
        raise ValueError("runs need at least four periods and one word")
    ship_package(docs.sparkSession)
    src = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    run_type = T.StructType([T.StructField(f, T.LongType()) for f in ("start", "length", "period")])
    schema = T.StructType([src.schema[key], T.StructField("runs", T.ArrayType(run_type)),
                           T.StructField("collapsed", T.StringType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b.column(1), AT_ONCE):
                runs, collapsed = _block(b.column(1).slice(i, j - i), times, least)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), runs, collapsed.cast(pa.string())], names)

    return src.mapInArrow(tidy(run), schema)


def echo_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``text``, where with h = crc32 of the decimal key and g = h div 10 the texts of
    h mod 10 = 0 repeat a passage to their end: word i >= a becomes word a + (i - a) mod p, for
    a = g mod n and p = 1 + (n - a) div (3 + g mod 8).  Texts without words or key stay."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def echoed(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        new = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(
            F.get(words, (a + F.pmod(i - a, p)).cast("int"))))
        return F.when(n > 0, F.array_join(new, " ")).otherwise(F.col(text))

    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    # one evaluation of the words: a one-element array is transformed
    tail = F.element_at(F.transform(F.array(words), echoed), 1)
    return docs.select(F.col(key).alias(key),
                       F.when(F.coalesce(h % 10 == 0, F.lit(False)), tail).otherwise(F.col(text)).alias(text))


def run_summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The runs of each document in numbers and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return found.withColumn("_best", best).select(
        key, F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("_best.length") / -F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
