"""Ledger filters and per-account aggregates (B2, B3, U2, D-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.core import money


def filter_account(ledger: DataFrame, account_id: str) -> DataFrame:
    """B2: rows where the account sends or receives."""
    return ledger.where((F.col("sender_id") == account_id) | (F.col("receiver_id") == account_id))


def filter_accounts(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """B2 for a set of accounts (column ``account_id``): two semi-joins, one scan each."""
    a = accounts.select(F.col("account_id")).distinct()
    by_s = ledger.join(a.withColumnRenamed("account_id", "sender_id"), "sender_id", "left_semi")
    by_r = ledger.join(a.withColumnRenamed("account_id", "receiver_id"), "receiver_id", "left_semi")
    # a row touching two listed accounts must appear once
    return by_s.unionByName(by_r.join(a.withColumnRenamed("account_id", "sender_id"),
                                      "sender_id", "left_anti"))


def filter_steps(ledger: DataFrame, start_step: int, end_step: int) -> DataFrame:
    """Inclusive step range (pushed to the scan when the ledger is a Parquet table)."""
    return ledger.where(F.col("step").between(start_step, end_step))


def participations(ledger: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per (transaction, role), roles stacked in one pass over the ledger; a missing
    party gives no row.

    Columns: ``account_id``, ``counterparty``, ``slot`` (0 sender, 1 receiver), ``step``,
    ``row_id``, ``amount`` and any ``extra`` ledger columns.
    """
    extra = extra or []
    keep = [c for c in ["step", "row_id", "amount", *extra] if c in ledger.columns]
    roles = F.array(
        F.struct(F.lit(0).alias("slot"), F.col("sender_id").alias("account_id"),
                 F.col("receiver_id").alias("counterparty")),
        F.struct(F.lit(1).alias("slot"), F.col("receiver_id").alias("account_id"),
                 F.col("sender_id").alias("counterparty")),
    )
    return ledger.select(*keep, F.explode(roles).alias("_p")).select(
        "_p.account_id", "_p.counterparty", "_p.slot", *keep).where(F.col("account_id").isNotNull())


def account_history(ledger: DataFrame) -> DataFrame:
    """D-1 for every account: sent/received counts and totals; a self transfer counts twice."""
    p = participations(ledger)
    sent = F.col("slot") == 0
    return p.groupBy("account_id").agg(
        F.count_if(sent).alias("sent_count"),
        F.count_if(~sent).alias("received_count"),
        F.coalesce(F.sum(F.when(sent, money("amount"))), F.lit(0)).cast("double").alias("total_sent"),
        F.coalesce(F.sum(F.when(~sent, money("amount"))), F.lit(0)).cast("double")
        .alias("total_received"),
        F.count(F.lit(1)).alias("tx_count"),
    )
