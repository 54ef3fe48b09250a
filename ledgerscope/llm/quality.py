"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

Each rule is a measure of a text and a fixed ladder of cutoffs from lenient to strict; a
document breaks the rule when its measure exceeds the chosen cutoff.  The cutoff of a rule in
a stratum (a language of a closed list, or ``other``) comes from all labelled documents there:

* ``n`` good documents of the stratum that pass the base rules, ``k`` of which the cutoff would
  reject.  The exact binomial tail P(Bin(n, alpha/R) <= k) is the p-value of "this cutoff
  rejects more than alpha/R of good documents"; R rules share alpha, so the union of the rules
  keeps to alpha in every stratum.
* Multiple testing: the ladder is tested in its fixed order from lenient to strict and stops
  at the first cutoff that isn't certified (fixed-sequence testing needs no correction inside
  a ladder); the R x S ladders are corrected by Bonferroni, each at delta / (R * S).
* Of the certified cutoffs the one with the largest gain (bad documents rejected minus
  ``cost`` times good ones) is taken, the most lenient on ties; no cutoff where none gains, and
  none where there are too few labels to certify one.

Defined cases: NULL text counts as empty (no word, fails the base).  A document with two
labels counts as good if any of them is good; a NULL label is no label.  Rows whose ``doc_id``
is NULL have no label.  Repeated rows are judged alike and all kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import checkpointed, text_or_empty

#: White space between words (space and code points 9 to 13), and the symbol characters.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STRATA = ("de", "en", "es", "fr")

#: Rule -> cutoffs from lenient to strict (a measure above the cutoff breaks the rule).
LADDERS: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_ratio": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "long_words": (30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0),
    "short_words": (-1.5, -2.0, -2.5, -3.0),
}


def base_metrics(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the base counts of every whole text, plus ``n_lines``.

    Words, windows and lines are arrays inside the row, so nothing is shuffled.  Equal
    three-word windows are found by sorting their 64-bit hashes with their positions.
    """
    t = F.col("_text")
    d = docs.select(*keep, text_or_empty("text").alias("_text"))
    d = d.select(*keep, "_text",
                 F.filter(F.split(t, SPACE), lambda w: w != "").alias("_words"),
                 F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    n = F.size("_words")
    d = d.select(*keep, "_lines",
                 n.cast("long").alias("n_words"),
                 F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                 (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long")
                 .alias("n_symbols"),
                 F.size("_lines").cast("long").alias("n_lines"),
                 F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"))
    d = d.withColumn("_h", _pair_hash(F.col("_h")))       # two words
    d = d.withColumn("_h", _pair_hash(F.col("_h")))       # two overlapping pairs: three words
    at = F.when(F.size(F.array_distinct("_h")) < F.size("_h"),
                F.sort_array(F.zip_with("_h", F.sequence(F.lit(0), F.size("_h") - 1),
                                        lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("_at", at)
    m = F.size("_at")
    same = F.zip_with(F.slice("_at", F.lit(1), m - 1), F.slice("_at", F.lit(2), m - 1),
                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    twice = F.array_distinct(F.flatten(F.filter(same, lambda p: p.isNotNull())))
    covered = F.size(F.array_distinct(F.flatten(
        F.transform(twice, lambda p: F.array(p, p + 1, p + 2)))))
    # The counts leave through a generator of one row: conditions on them and further columns
    # made of them can't be merged into (and so repeat) the expressions that make them.
    return d.select(*keep, F.inline(F.array(F.struct(
        "n_words", "word_chars", "n_symbols",
        (F.col("n_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_at").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        "n_lines"))))


def _pair_hash(a: Column) -> Column:
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n),
                      lambda x, y: F.xxhash64(x, y))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
        "short_words": -F.col("word_chars") / words,
    }


def stratum(lang: Column, strata: Sequence[str] = STRATA) -> Column:
    return F.when(lang.isin(*strata), lang).otherwise(F.lit("other"))


# ------------------------------------------------------------------ exact binomial bound
def _ln_factorial(n: Column) -> Column:
    """ln n! of an integer column: a table below 16, Stirling's series above (error < 1e-11)."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = F.greatest(n, F.lit(16)).cast("double")
    series = (x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x)
              - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5))
    return F.when(n < 16, F.get(small, F.least(n, F.lit(15)).cast("int"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k <= n p, else 1 (such a cutoff is never certified).

    The terms are added from k downwards; below the mean they fall at least as fast as a
    normal tail, so ten standard deviations and 60 terms hold all of the sum a double can show.
    """
    below = (F.lit(60) + F.ceil(10 * F.sqrt(n * p * (1 - p)))).cast("long")
    first = F.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)
                  + k * math.log(p) + (n - k) * math.log1p(-p))
    terms = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.least(k, below)),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda s, j: F.struct(
            (s["term"] * ((k - j) / (n - k + j + 1).cast("double")) * ((1 - p) / p)).alias("term"),
            (s["total"] + s["term"]).alias("total")),
        lambda s: s["total"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(first * terms, F.lit(1.0)))


# ------------------------------------------------------------------ calibration
def ladder_counts(labelled: DataFrame, ladders: dict[str, tuple[float, ...]] = LADDERS) -> DataFrame:
    """(stratum, rule, step, cutoff, n, k, bad): good documents, good and bad ones rejected at
    each step of each ladder.  ``labelled``: stratum, the measures, good (boolean).

    Cutoffs only get stricter, so the first step that a document breaks says it all: counts by
    first broken step, then a running sum over the steps (a table of fixed size).
    """
    def first_step(rule: str) -> Column:
        hit = F.lit(len(ladders[rule]))
        for i in range(len(ladders[rule]) - 1, -1, -1):
            hit = F.when(F.col(rule) > ladders[rule][i], i).otherwise(hit)
        return hit

    rows = labelled.select("stratum", "good", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), first_step(r).alias("step")) for r in ladders])).alias("s"))
    counts = rows.groupBy("stratum", F.col("s.rule").alias("rule"), F.col("s.step").alias("step")).agg(
        F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b"))
    steps = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"))
                      for r, cs in ladders.items() for i, c in enumerate((*cs, math.inf))])
    grid = (counts.select("stratum").distinct().select("stratum", F.explode(steps).alias("s"))
            .select("stratum", "s.*"))
    full = grid.join(counts, ["stratum", "rule", "step"], "left")
    w = Window.partitionBy("stratum", "rule")
    up = w.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    return full.select("stratum", "rule", "step", "cutoff",
                       F.coalesce(F.sum("g").over(w), zero).alias("n"),
                       F.coalesce(F.sum("g").over(up), zero).alias("k"),
                       F.coalesce(F.sum("b").over(up), zero).alias("bad")
                       ).where(F.col("cutoff") < math.inf)


def choose_cutoffs(counts: DataFrame, alpha: float = 0.05, delta: float = 0.05, cost: float = 4.0,
                   n_rules: int = len(LADDERS), n_strata: int = len(STRATA) + 1) -> DataFrame:
    """Per (stratum, rule) the certified cutoff of the largest gain; pairs without one are
    missing.  Columns ``stratum, rule, cutoff, p_value``."""
    p = binomial_tail(F.col("n"), F.col("k"), alpha / n_rules)
    w = Window.partitionBy("stratum", "rule").orderBy("step")
    tested = counts.withColumn("p_value", p).withColumn(
        "certified", F.max("p_value").over(w.rowsBetween(Window.unboundedPreceding, 0))
        <= delta / (n_rules * n_strata))
    gain = F.col("bad") - cost * F.col("k")
    best = F.max(F.struct(gain.alias("gain"), (-F.col("step")).alias("_s"), "cutoff", "p_value"))
    return (tested.where(F.col("certified") & (gain > 0)).groupBy("stratum", "rule")
            .agg(best.alias("b")).select("stratum", "rule", "b.cutoff", "b.p_value"))


def calibrate(metrics: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05,
              cost: float = 4.0) -> DataFrame:
    """One row per stratum: ``stratum`` and ``_c_<rule>``, the chosen cutoff of each rule (NULL:
    none).  At most len(STRATA) + 1 rows.  ``metrics``: doc_id, stratum and the base counts."""
    good = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg((F.max("quality") >= 1).alias("good")))
    m = metrics.where(~base_failed()).select("doc_id", "stratum", *[c.alias(r) for r, c in measures().items()])
    labelled = m.join(good, "doc_id").select("stratum", "good", *LADDERS)
    chosen = choose_cutoffs(ladder_counts(labelled), alpha, delta, cost)
    return chosen.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_c_{r}") for r in LADDERS])


def verdicts(metrics: DataFrame, cutoffs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, the base counts, ``base_failed``, the first calibrated rule that is broken
    (``broken_rule``) and ``kept``.  ``cutoffs`` has one row per stratum of a closed list."""
    j = metrics.join(F.broadcast(cutoffs), "stratum", "left")
    broken = F.coalesce(*[F.when(c > F.col(f"_c_{r}"), F.lit(r)) for r, c in measures().items()])
    out = j.select(*keep, *BASE, base_failed().alias("base_failed"), broken.alias("_broken"))
    return out.select(*keep, *BASE, "base_failed",
                      F.when(~F.col("base_failed"), F.col("_broken")).alias("broken_rule"),
                      (~F.col("base_failed") & F.col("_broken").isNull()).alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, **risk) -> DataFrame:
    """``doc_id`` of every document with its counts and verdict.

    The counts are materialised once (a narrow table in the shared checkpoint folder), since
    both the calibration and the verdicts read them.
    """
    src = docs.select("doc_id", "text", stratum(F.col("lang")).alias("stratum"))
    m = checkpointed(base_metrics(src, ["doc_id", "stratum"]))
    return verdicts(m, checkpointed(calibrate(m, labels, **risk)), ["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame, **risk) -> DataFrame:
    """The rows of ``docs`` (same columns) that the rules keep.

    The counts of the calibration and of the verdicts are made in a pass each: counting twice
    costs less than shuffling the texts to meet their verdicts.
    """
    strat = stratum(F.col("lang")).alias("stratum")
    m = checkpointed(base_metrics(docs.select("doc_id", "text", strat), ["doc_id", "stratum"]))
    cutoffs = checkpointed(calibrate(m, labels, **risk))
    # the row travels as one struct, so its columns can't clash with the counts
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", strat)
    out = verdicts(base_metrics(src, ["_row", "stratum"]), cutoffs, ["_row"])
    return out.where("kept").select("_row.*")
