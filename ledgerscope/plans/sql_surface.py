"""The ad-hoc SQL surface: the store and ledger as temp views, queried with Spark SQL.

Users of the reference ran a few SQL statements directly against their findings
database (breakdown by type, first account of a type, findings feeding the detection
rate, deleting a case's findings).  Here the same statements run on Spark over the temp views
``ledger``, ``events``, ``cases``, ``evidence`` and ``findings``; the DELETE is
``CaseStore.delete_findings`` (a reset row: the case's findings aren't read any more).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.operators import analyze as A
from ledgerscope.operators import timeline as T
from ledgerscope.plans.analytics import CASE, findings_sql
from ledgerscope.plans.catalog import L, register


def register_views(spark: SparkSession, **tables: DataFrame) -> None:
    """Expose DataFrames as temp views, e.g. ``ledger=..., findings=..., cases=...``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def register_store(spark: SparkSession, store, ledger: DataFrame | None = None) -> None:
    """The views of a case store and, if given, of a ledger and its timeline events.  They show the
    store as it is now; register again after a change."""
    register_views(spark, cases=store.cases(), evidence=store.evidence(), findings=store.findings())
    if ledger is not None:
        register_views(spark, ledger=ledger, events=T.timeline(ledger))


BREAKDOWN = """
SELECT finding_type, COUNT(*) AS count, ROUND(AVG(confidence), 2) AS avg_confidence
FROM findings WHERE case_id = '{case}'
GROUP BY finding_type ORDER BY COUNT(*) DESC"""

FIRST_ACCOUNT = """
SELECT account_ids[0] AS account_id FROM findings
WHERE case_id = '{case}' AND finding_type = 'rapid_drain'
ORDER BY step_start, account_ids[0] LIMIT 1"""

COVERAGE_ROWS = """
SELECT account_ids, step_start, step_end FROM findings
WHERE case_id = '{case}' AND finding_type != 'balance_inconsistency'"""


PER_CASE = """
SELECT c.id AS case_id, COALESCE(f.n, 0) AS n_findings, COALESCE(e.n, 0) AS n_evidence
FROM cases c LEFT JOIN (SELECT case_id, COUNT(*) AS n FROM findings GROUP BY case_id) f ON f.case_id = c.id
             LEFT JOIN (SELECT case_id, COUNT(*) AS n FROM evidence GROUP BY case_id) e ON e.case_id = c.id"""

EVENTS_OF_FLAGGED = """
SELECT e.account_id, COUNT(*) AS n_events, MIN(e.step) AS first_step, MAX(e.step) AS last_step
FROM events e WHERE e.account_id IN (SELECT explode(account_ids) FROM findings WHERE finding_type = 'rapid_drain')
GROUP BY e.account_id"""


def _views(spark, sf_dir):
    led = L(spark, sf_dir)
    register_views(spark, ledger=led, findings=A.to_payload(A.analyze(led), CASE))


@register("sql_breakdown", findings_sql(
    "SELECT finding_type, CAST(COUNT(*) AS BIGINT) AS count, ROUND(AVG(confidence), 2) "
    f"AS avg_confidence FROM stored WHERE case_id = '{CASE}' GROUP BY finding_type"))
def q_sql_breakdown(spark, sf_dir):
    _views(spark, sf_dir)
    return spark.sql(BREAKDOWN.format(case=CASE))


@register("sql_first_account", findings_sql(
    f"SELECT account_ids[1] AS account_id FROM stored WHERE case_id = '{CASE}' "
    "AND finding_type = 'rapid_drain' ORDER BY step_start, account_ids[1] LIMIT 1"))
def q_sql_first_account(spark, sf_dir):
    _views(spark, sf_dir)
    return spark.sql(FIRST_ACCOUNT.format(case=CASE))


@register("sql_coverage_rows", findings_sql(
    f"SELECT account_ids, step_start, step_end FROM stored WHERE case_id = '{CASE}' "
    "AND finding_type <> 'balance_inconsistency'"))
def q_sql_coverage_rows(spark, sf_dir):
    _views(spark, sf_dir)
    return spark.sql(COVERAGE_ROWS.format(case=CASE))
