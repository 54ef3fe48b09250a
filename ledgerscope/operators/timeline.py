"""Account timelines (T1), annotations (T2), narratives (T3) and record export (T4).

All accounts are handled in one job; the single-account form is a filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.core import money
from ledgerscope.operators.findings import merge_intervals, covered_steps

# Annotation labels and narrative sentences (fixed values).
LABEL_DRAIN = "[RAPID DRAIN]"
LABEL_DORMANT = "[DORMANT ACTIVATION]"
LABEL_DRAINED = "[ACCOUNT DRAINED]"
LABEL_FLAGGED = "[FLAGGED BY PAYSIM]"
NARRATIVE = (
    "The forensic analysis of account %s reveals a sequence of %d transaction events "
    "indicative of %s. "
    "The suspicious sequence commenced at step %d, marking the start of the detected pattern. "
    "Throughout the observed timeline, a total amount of %.2f was moved through the account. "
)
CLOSING_WITH_FINDINGS = "The primary detected mechanism driving this anomaly is classified as %s."
CLOSING_WITHOUT = ("These movements exhibit characteristics consistent with unauthorized or "
                   "anomalous financial flows.")
NO_EVENTS = "No transaction events found for account %s."
DEFAULT_PATTERN = "suspicious activity"
FLAGGED_PATTERN = "flagged transactions"

# Order of the detectors (fixed values).
DETECTOR_ORDER = ("rapid_drain", "round_trip", "fan_out", "fan_in", "dormant_activation",
                  "balance_inconsistency")

_MAX_STEP = 9223372036854775807


def timeline(ledger: DataFrame, accounts: DataFrame | None = None, by: tuple[str, ...] = ()
             ) -> DataFrame:
    """One event per (account, transaction) in the account's view.

    A self transfer gives one (sender) event, a missing party none.  ``accounts`` (columns
    ``by`` and ``account_id``) restricts the output by a semi-join.  ``by`` (e.g. ``("case_id",)``)
    names ledger columns that keep ledgers apart; they lead the output.
    """
    base_type = F.coalesce(F.col("tx_type"), F.lit("nan"))
    sender = F.struct(
        F.lit(0).alias("slot"), F.col("sender_id").alias("account_id"),
        F.col("receiver_id").alias("counterparty"),
        F.col("sender_balance_before").alias("balance_before"),
        F.col("sender_balance_after").alias("balance_after"),
        F.concat(base_type, F.lit("_SENDER")).alias("event_type"))
    receiver = F.when(~F.col("receiver_id").eqNullSafe(F.col("sender_id")), F.struct(
        F.lit(1).alias("slot"), F.col("receiver_id").alias("account_id"),
        F.col("sender_id").alias("counterparty"),
        F.col("receiver_balance_before").alias("balance_before"),
        F.col("receiver_balance_after").alias("balance_after"),
        F.concat(base_type, F.lit("_RECEIVER")).alias("event_type")))
    flagged = (F.coalesce(F.col("is_flagged"), F.lit(False)) if "is_flagged" in ledger.columns
               else F.lit(False))
    known = F.filter(F.array(sender, receiver), lambda x: x.isNotNull() & x["account_id"].isNotNull())
    ev = ledger.select(*by, "step", "row_id", "amount", flagged.alias("is_flagged"),
                       F.explode(known).alias("e"))
    ev = ev.select(*by, "e.account_id", "step", "row_id", "e.slot", "e.event_type", "amount",
                   "e.counterparty", "e.balance_before", "e.balance_after",
                   F.lit("").alias("annotation"), "is_flagged")
    if accounts is not None:
        keys = [*by, "account_id"]
        ev = ev.join(accounts.select(*keys), keys, "left_semi").select(*ev.columns)
    return ev


def _finding_rows(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Normalise findings to (by, account_id, pattern, step_start, step_end, seq)."""
    f = findings
    if "account_id" not in f.columns and "account_ids" in f.columns:
        f = f.select("*", F.explode("account_ids").alias("account_id"))
    pattern = F.col("pattern") if "pattern" in f.columns else F.col("finding_type")
    # stored findings carry no detector number: their type gives it
    seq = (F.col("detector_seq") if "detector_seq" in f.columns
           else F.array_position(F.array(*[F.lit(p) for p in DETECTOR_ORDER]), pattern))
    start = F.col("step_start") if "step_start" in f.columns else F.lit(None)
    end = F.col("step_end") if "step_end" in f.columns else F.lit(None)
    return f.select(*by, "account_id", pattern.alias("pattern"),
                    F.coalesce(start.cast("long"), F.lit(0).cast("long")).alias("step_start"),
                    F.coalesce(end.cast("long"), F.lit(_MAX_STEP)).alias("step_end"),
                    seq.alias("seq"))


def annotate(events: DataFrame, findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Labels from findings of the event's account (and ``by`` keys) whose interval holds the step
    (rapid drain, dormant activation), then drained / flagged-transfer labels; prior
    annotation first, duplicates removed, space separated.

    Intervals are merged per (account, pattern) and met at (account, step), so the row count never grows.
    """
    fr = _finding_rows(findings, by)
    keys = [*by, "account_id"]
    marking = fr.where(F.col("pattern").isin("rapid_drain", "dormant_activation"))
    # one join for both patterns: a flag per pattern for each distinct (account, step)
    held = covered_steps(events, merge_intervals(marking, [*keys, "pattern"]), keys).groupBy(
        *[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)], F.col("step").alias("_step")).agg(
        F.max(F.when(F.col("pattern") == "rapid_drain", True)).alias("_drain_acct"),
        F.max(F.when(F.col("pattern") == "dormant_activation", True)).alias("_dormant_acct"))
    on = [events[k] == held[f"_p{i}"] for i, k in enumerate(keys)] + [events["step"] == held["_step"]]
    out = events.join(held, on, "left")
    drained = F.col("balance_after") < F.lit(0.01) * F.col("balance_before")
    flagged = F.col("event_type").contains("TRANSFER") & F.col("is_flagged")
    labels = F.array(
        F.when(F.coalesce(F.col("annotation"), F.lit("")) != "", F.col("annotation")),
        F.when(F.col("_drain_acct").isNotNull(), F.lit(LABEL_DRAIN)),
        F.when(F.col("_dormant_acct").isNotNull(), F.lit(LABEL_DORMANT)),
        F.when(drained, F.lit(LABEL_DRAINED)),
        F.when(flagged, F.lit(LABEL_FLAGGED)))
    ann = F.trim(F.array_join(F.array_distinct(F.filter(labels, lambda x: x.isNotNull())), " "))
    return out.withColumn("annotation", ann).select(*events.columns)


def narratives(events: DataFrame, findings: DataFrame, accounts: DataFrame | None = None,
               by: tuple[str, ...] = ()) -> DataFrame:
    """One narrative per account and ``by`` keys (all accounts with events, or the given
    ``accounts``).

    Primary pattern and start step come from the earliest finding (by step_start), else
    the first flagged event, else the first event.
    """
    keys = [*by, "account_id"]
    per = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(money("amount")).cast("double").alias("total_amount"),
        F.min("step").alias("first_step"),
        F.min(F.when(F.col("is_flagged"), F.col("step"))).alias("first_flagged_step"))
    fr = _finding_rows(findings, by)
    first = fr.groupBy(*keys).agg(F.min(F.struct(
        "step_start", "seq", "pattern")).alias("ff"))
    j = per.join(first, keys, "left")
    has = F.col("ff").isNotNull()
    pattern = (F.when(has, F.translate(F.col("ff.pattern"), "_", " "))
               .when(F.col("first_flagged_step").isNotNull(), F.lit(FLAGGED_PATTERN))
               .otherwise(F.lit(DEFAULT_PATTERN)))
    start = F.when(has, F.col("ff.step_start")).otherwise(
        F.coalesce("first_flagged_step", "first_step"))
    text = F.concat(
        F.format_string(NARRATIVE, F.col("account_id"), F.col("n_events"), pattern, start,
                        F.col("total_amount")),
        F.when(has, F.format_string(CLOSING_WITH_FINDINGS, pattern)).otherwise(
            F.lit(CLOSING_WITHOUT)))
    out = j.select(*keys, "n_events", "total_amount", pattern.alias("primary_pattern"),
                   start.alias("first_suspicious_step"), text.alias("narrative"))
    if accounts is not None:
        acc = accounts.select(*keys).distinct()
        out = acc.join(out, keys, "left").select(
            *keys, F.coalesce("n_events", F.lit(0)).alias("n_events"), "total_amount",
            "primary_pattern", "first_suspicious_step",
            F.coalesce("narrative", F.format_string(NO_EVENTS, F.col("account_id")))
            .alias("narrative"))
    return out


def timeline_json(events: DataFrame) -> DataFrame:
    """T4: one JSON record per event (the dict form); ``(step, row_id, slot)`` is the
    timeline order of an account's records (no per-account numbering pass)."""
    cols = ["step", "event_type", "amount", "counterparty", "balance_before", "balance_after",
            "annotation", "is_flagged"]
    return events.select("account_id", "step", "row_id", "slot",
                         F.to_json(F.struct(*cols)).alias("record"))
