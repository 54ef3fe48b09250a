"""The 13 leakage-free transaction features (M1: F1-F6, W2-W4).

Output: the ledger key columns plus ``FEATURE_COLUMNS`` (all double).  Row order is
"by step" with ``row_id`` as the tie-break, so "prior" always means earlier in that
order.

Skew: an account's rows are ranked within stretches of time, to which the counts of earlier
stretches are added (rows without a step come before all others and have no features).  The expanding median (W3) and the velocity come from range-sorted
chunks, not from senders (``operators.running``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.operators.running import running_median
from ledgerscope.schemas import FEATURE_COLUMNS, TX_TYPES


#: Steps of a stretch of time, in bits.
_STRETCH_BITS = 7


def _prior_count(df: DataFrame, key: str) -> DataFrame:
    """Rows of the same ``key`` strictly before each row in (step, row_id) order: those of earlier stretches of time
    by count, those of its own by place, so the rows are shuffled once."""
    stretch = F.shiftright("step", _STRETCH_BITS)
    cells = df.groupBy(key, stretch.alias("_stretch")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = cells.select(key, "_stretch", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_earlier"))
    own = Window.partitionBy(key, "_stretch").orderBy("step", "row_id")
    return (df.withColumn("_stretch", stretch).withColumn("_place", F.row_number().over(own) - 1)
            .join(earlier, [key, "_stretch"])
            .withColumn(f"{key}_prior", F.col("_earlier") + F.col("_place"))
            .drop("_earlier", "_place", "_stretch"))


def _bit(condition: Column, bit: int) -> Column:
    return F.when(condition, 1 << bit).otherwise(0).cast("short")


def _marked(bit: int) -> Column:
    """1.0 where a bit of ``_marks`` is set: the conditions on a row's own columns travel as one short number."""
    return F.bit_get(F.col("_marks"), F.lit(bit)).cast("double")


def features(ledger: DataFrame, velocity_span: int = 10, keep: tuple[str, ...] = (),
             median_partitions: int | None = None) -> DataFrame:
    """M1: ``row_id``, ``step``, ``sender_id``, ``receiver_id``, ``keep`` + the 13 features of every
    row with both parties.  ``median_partitions``: chunks of the running median (else AQE's choice)."""
    ledger = ledger.where(F.col("sender_id").isNotNull() & F.col("receiver_id").isNotNull())
    amt = F.col("amount").cast("double")
    before = F.col("sender_balance_before")
    after = F.col("sender_balance_after")
    marks = _bit(after < F.lit(0.1) * before, 0) + _bit(F.abs(before - amt - after) > F.lit(0.01), 1)
    for i, t in enumerate(TX_TYPES):
        marks = marks + _bit(F.col("tx_type") == t, i + 2)
    # what a row's own columns give is worked out first, so that few and narrow columns travel
    base = ledger.select(
        "row_id", "step", "sender_id", "receiver_id", "amount", F.try_divide(amt, before + F.lit(1.0)).alias("_ratio"), marks.alias("_marks"), *keep)
    f = _prior_count(base, "receiver_id")
    f = running_median(f, "sender_id", ["step", "row_id"], "amount", "historical_median", median_partitions,
                       recent=("step", velocity_span, "_recent"))
    f = f.withColumn("historical_median", F.coalesce("historical_median", F.lit(0.0)))
    cols = {
        "amount": amt,
        **{f"tx_type_{t}": _marked(i + 2) for i, t in enumerate(TX_TYPES)},
        "balance_change_ratio": F.col("_ratio"),
        "sender_drained": _marked(0),
        "balance_mismatch": _marked(1),
        "receiver_prior_tx_count": F.col("receiver_id_prior").cast("double"),
        "sender_tx_velocity": F.col("_recent").cast("double"),
        "amount_vs_sender_median": F.try_divide(amt, F.col("historical_median") + F.lit(1.0)),
        "hour_of_day": (F.col("step") % 24).cast("double"),
    }
    assert list(cols) == FEATURE_COLUMNS
    return f.select("row_id", "step", "sender_id", "receiver_id", *keep,
                    *[c.alias(n) for n, c in cols.items()])


def labelled_features(ledger: DataFrame, velocity_span: int = 10) -> DataFrame:
    """Features with the ``is_fraud`` label as ``label`` (0/1), carried through (no join)."""
    return features(ledger, velocity_span, keep=("is_fraud",)).withColumn(
        "label", F.col("is_fraud").cast("int")).drop("is_fraud")
