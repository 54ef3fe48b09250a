"""E7 ``analyze`` and the detector registry; B4 account-scoped analysis; B5/B6 payload."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.core import severity
from ledgerscope.operators import detectors as D
from ledgerscope.operators.ledger_ops import filter_account
from ledgerscope.schemas import FINDING_COLUMNS
from ledgerscope.session import checkpoint_dir

_REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = dict(D.DETECTORS)


def register_detector(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Add a detector: a function ledger -> findings with ``FINDING_COLUMNS`` (it must accept
    ``by=`` to take part in multi-case analysis)."""
    _REGISTRY[name] = fn


def detectors() -> list[str]:
    return list(_REGISTRY)


#: Ledger columns that a detector may read.
DETECTOR_COLUMNS = ("step", "row_id", "amount", "sender_id", "receiver_id", "sender_balance_before",
                    "sender_balance_after")


#: Further columns that a timeline reads.
TIMELINE_COLUMNS = ("tx_type", "receiver_balance_before", "receiver_balance_after", "is_flagged")


def materialized(ledger: DataFrame, by: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame:
    """The ledger, written once and read back.  With only the built-in detectors, their columns
    (and ``extra`` ones) are enough; a registered one may read any."""
    spark = ledger.sparkSession
    own = set(_REGISTRY) == set(D.DETECTORS)
    cols = [c for c in ledger.columns if not own or c in (*DETECTOR_COLUMNS, *by, *extra)]
    if not cols:
        return ledger
    path = f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    ledger.select(*cols).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(ledger.select(*cols).schema).parquet(path)


def analyze(ledger: DataFrame, detectors: list[str] | None = None,
            account: str | None = None, by: tuple[str, ...] = (), written: bool = False) -> DataFrame:
    """All detectors in registry order, as one DataFrame with ``detector_seq``.

    ``account`` (B4) restricts the *input* first, so medians and candidate sets see only
    that account's rows, as the reference does.  ``by`` (e.g. ``("case_id",)``) analyses
    every case of a multi-case ledger in the same job, each as its own ledger.

    The columns that the detectors use are written once as Parquet under the shared checkpoint
    folder: whatever made the ledger runs once, and every detector reads its own columns.
    ``written``: the ledger is such a table already (``materialized``).
    """
    if account is not None:
        ledger = filter_account(ledger, account)
    if not written:
        ledger = materialized(ledger, by)
    names = detectors or list(_REGISTRY)
    out = None
    for seq, name in enumerate(names):
        fn = _REGISTRY[name]
        found = fn(ledger, by=tuple(by)) if by else fn(ledger)
        part = found.select(*by, *FINDING_COLUMNS).withColumn("detector_seq", F.lit(seq))
        out = part if out is None else out.unionByName(part)
    return out


def with_severity(findings: DataFrame) -> DataFrame:
    """B5."""
    return findings.withColumn("severity", severity("confidence"))


def to_payload(findings: DataFrame, case_id: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The stored-finding projection (amount kept, unlike the reference), after a fixed
    ``case_id`` or the ``by`` columns of a multi-case analysis."""
    cols = [
        *by,
        F.col("pattern").alias("finding_type"),
        severity("confidence").alias("severity"),
        F.col("description"),
        F.array(F.col("account_id")).alias("account_ids"),
        F.col("step_start"), F.col("step_end"), F.col("confidence"), F.col("amount"),
    ]
    if case_id is not None:
        cols.insert(0, F.lit(case_id).alias("case_id"))
    return findings.select(*cols)
