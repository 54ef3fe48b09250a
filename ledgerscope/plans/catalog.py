"""Registered queries: name -> (Spark builder (spark, sf_dir) -> DataFrame, oracle SQL or None).

Every query reads the driver's tables (the order-table ledger derived from
``lineitem`` and ``orders``, or other tables) in full.  Doubles that come out of
aggregations are exact decimal sums, so Spark and the oracle agree bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.operators import analyze as A
from ledgerscope.operators import detectors as D
from ledgerscope.operators import ledger_ops as LO
from ledgerscope.plans.oracle import MONEY, ORDER, with_ledger
from ledgerscope.sources.tpch import order_ledger

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def L(spark: SparkSession, sf_dir: str, dense: bool = False, steps=None) -> DataFrame:
    return order_ledger(spark, sf_dir, dense, steps)


LEDGER_OUT = ["step", "tx_type", "amount", "sender_id", "sender_balance_before",
              "sender_balance_after", "receiver_id", "receiver_balance_before",
              "receiver_balance_after", "is_fraud", "is_flagged"]
_LCOLS = ", ".join(LEDGER_OUT)

# ------------------------------------------------------------------ detector SQL
FINDING_SQL = "pattern, account_id, step_start, step_end, amount, confidence, description"


def sql_rapid_drain() -> str:
    return f"""
SELECT 'rapid_drain' AS pattern, sender_id AS account_id, s0 AS step_start, s1 AS step_end,
       CAST(amt AS DOUBLE) AS amount, CAST(0.9 AS DOUBLE) AS confidence,
       'Rapid drain detected' AS description
FROM (
  SELECT i.sender_id, i.step AS s0, j.step AS s1,
         j.cs - i.cs + CAST(COALESCE(i.amount, 0) AS {MONEY}) AS amt,
         ROW_NUMBER() OVER (PARTITION BY i.sender_id ORDER BY i.rn, j.rn) AS pick
  FROM dr i JOIN dr j
    ON i.sender_id = j.sender_id AND j.rn >= i.rn AND j.step - i.step <= 5
  WHERE i.b > 0 AND j.a < CAST(0.1 AS DOUBLE) * i.b
    AND j.cs - i.cs + CAST(COALESCE(i.amount, 0) AS {MONEY}) > 0
) WHERE pick = 1"""


DR_CTE = f"""dr AS (
  SELECT sender_id, step, amount, sender_balance_before AS b, sender_balance_after AS a,
         ROW_NUMBER() OVER (PARTITION BY sender_id ORDER BY {ORDER}) AS rn,
         SUM(CAST(COALESCE(amount, 0) AS {MONEY})) OVER (
           PARTITION BY sender_id ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS cs
  FROM ledger)"""


def sql_round_trip() -> str:
    return """
SELECT 'round_trip' AS pattern, x.sender_id AS account_id, x.step AS step_start,
       y.step AS step_end, x.amount AS amount, CAST(0.85 AS DOUBLE) AS confidence,
       'Round trip: ' || x.sender_id || ' -> ' || x.receiver_id || ' -> ' || x.sender_id
         AS description
FROM ledger x JOIN ledger y ON x.sender_id = y.receiver_id AND x.receiver_id = y.sender_id
WHERE y.step >= x.step AND y.step - x.step <= 10 AND x.amount > 0
  AND abs(x.amount - y.amount) / x.amount <= CAST(0.05 AS DOUBLE)"""


def sql_fan(role: str) -> str:
    acct, cpty = ("sender_id", "receiver_id") if role == "out" else ("receiver_id", "sender_id")
    pattern = f"fan_{role}"
    conf = 0.75 if role == "out" else 0.70
    text = "'Fan out to ' || n || ' receivers'" if role == "out" else \
        "'Fan in from ' || n || ' senders'"
    return f"""
SELECT '{pattern}' AS pattern, acct AS account_id, s AS step_start, se AS step_end,
       CAST(amt AS DOUBLE) AS amount, CAST({conf} AS DOUBLE) AS confidence, {text} AS description
FROM (
  SELECT st.acct, st.s, COUNT(DISTINCT l.{cpty}) AS n, MAX(l.step) AS se,
         SUM(CAST(l.amount AS {MONEY})) AS amt,
         ROW_NUMBER() OVER (PARTITION BY st.acct ORDER BY st.s) AS pick
  FROM (SELECT DISTINCT {acct} AS acct, step AS s FROM ledger) st
  JOIN ledger l ON l.{acct} = st.acct AND l.step BETWEEN st.s AND st.s + 10
  GROUP BY st.acct, st.s
  HAVING COUNT(DISTINCT l.{cpty}) > 5
) WHERE pick = 1"""


MEDIAN_CTE = """med_ord AS (
  SELECT amount AS v, ROW_NUMBER() OVER (ORDER BY amount) AS rn, COUNT(*) OVER () AS n
  FROM ledger WHERE amount IS NOT NULL),
med AS (SELECT AVG(v) AS m FROM med_ord WHERE rn = (n + 1) // 2 OR rn = n // 2 + 1)"""


def sql_dormant() -> str:
    return f"""
SELECT 'dormant_activation' AS pattern, acct AS account_id, step AS step_start,
       step AS step_end, amount, CAST(0.8 AS DOUBLE) AS confidence,
       'Dormant account activation' AS description
FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY acct ORDER BY {ORDER}, slot) AS rn
  FROM (SELECT sender_id AS acct, 0 AS slot, * FROM ledger
        UNION ALL SELECT receiver_id AS acct, 1 AS slot, * FROM ledger)
) , med
WHERE slot = 0 AND rn <= 3 AND amount > 2 * m"""


def sql_balance() -> str:
    return """
SELECT 'balance_inconsistency' AS pattern, 'DATASET' AS account_id, s0 AS step_start,
       s1 AS step_end, CAST(amt AS DOUBLE) AS amount, CAST(1.0 AS DOUBLE) AS confidence,
       printf('%d of %d transactions (%.1f%%) fail balance reconciliation - '
              || 'evidence-level data integrity flag', n_bad, n, CAST(n_bad AS DOUBLE) * 100.0 / n)
         AS description
FROM (
  SELECT COUNT(*) FILTER (WHERE bad) AS n_bad, COUNT(*) AS n,
         MIN(step) FILTER (WHERE bad) AS s0, MAX(step) FILTER (WHERE bad) AS s1,
         SUM(CAST(amount AS DECIMAL(38,6))) FILTER (WHERE bad) AS amt
  FROM (SELECT *, abs(sender_balance_before - sender_balance_after - amount) > 0.01 AS bad
        FROM ledger)
) WHERE n_bad > 0"""


def analyze_sql(dense: bool = False, where: str | None = None) -> str:
    body = "\nUNION ALL\n".join(
        f"SELECT {FINDING_SQL} FROM ({s})"
        for s in [sql_rapid_drain(), sql_round_trip(), sql_fan("out"), sql_fan("in"),
                  sql_dormant(), sql_balance()])
    return with_ledger(body, dense, extra=DR_CTE + ",\n" + MEDIAN_CTE, where=where)


# ------------------------------------------------------------------ ledger queries
@register("ledger_scan", with_ledger(f"SELECT {_LCOLS} FROM ledger"))
def q_ledger_scan(spark, sf_dir):
    return L(spark, sf_dir).select(*LEDGER_OUT)


@register("filter_account", with_ledger(
    f"SELECT {_LCOLS} FROM ledger WHERE sender_id = 'S1' OR receiver_id = 'S1'"))
def q_filter_account(spark, sf_dir):
    return LO.filter_account(L(spark, sf_dir), "S1").select(*LEDGER_OUT)


@register("filter_timerange", with_ledger(
    f"SELECT {_LCOLS} FROM ledger WHERE step BETWEEN 100 AND 200"))
def q_filter_timerange(spark, sf_dir):
    return LO.filter_steps(L(spark, sf_dir, steps=(100, 200)), 100, 200).select(*LEDGER_OUT)


@register("ledger_head", with_ledger(
    f"SELECT {_LCOLS} FROM ledger ORDER BY k1, k2, k3, k4, k5 LIMIT 100"))
def q_ledger_head(spark, sf_dir):
    from ledgerscope.sources.ledger import ledger_head
    return ledger_head(L(spark, sf_dir), 100).select(*LEDGER_OUT)


@register("participations", with_ledger("""
SELECT sender_id AS account_id, receiver_id AS counterparty, 0 AS slot, step, amount FROM ledger
UNION ALL
SELECT receiver_id, sender_id, 1, step, amount FROM ledger"""))
def q_participations(spark, sf_dir):
    return LO.participations(L(spark, sf_dir)).select(
        "account_id", "counterparty", "slot", "step", "amount")


@register("account_history", with_ledger(f"""
SELECT account_id,
       CAST(COUNT(*) FILTER (WHERE slot = 0) AS BIGINT) AS sent_count,
       CAST(COUNT(*) FILTER (WHERE slot = 1) AS BIGINT) AS received_count,
       CAST(COALESCE(SUM(CAST(amount AS {MONEY})) FILTER (WHERE slot = 0), 0) AS DOUBLE) AS total_sent,
       CAST(COALESCE(SUM(CAST(amount AS {MONEY})) FILTER (WHERE slot = 1), 0) AS DOUBLE)
         AS total_received,
       CAST(COUNT(*) AS BIGINT) AS tx_count
FROM (SELECT sender_id AS account_id, 0 AS slot, amount FROM ledger
      UNION ALL SELECT receiver_id, 1, amount FROM ledger)
GROUP BY account_id"""))
def q_account_history(spark, sf_dir):
    return LO.account_history(L(spark, sf_dir))


# ------------------------------------------------------------------ detectors
@register("balance_inconsistency", with_ledger(sql_balance()))
def q_balance(spark, sf_dir):
    return D.balance_inconsistency(L(spark, sf_dir))


@register("rapid_drain", with_ledger(sql_rapid_drain(), extra=DR_CTE))
def q_rapid_drain(spark, sf_dir):
    return D.rapid_drain(L(spark, sf_dir))


# mostly refunds, a third of the rows one sender's
REFUNDS_CTE = """refunds AS (
  SELECT * REPLACE (CASE WHEN k2 = 7 THEN amount ELSE -amount END AS amount,
                    CASE WHEN k1 % 3 = 0 THEN 'HOT' ELSE sender_id END AS sender_id) FROM ledger)"""


@register("rapid_drain_refunds", with_ledger(
    sql_rapid_drain(), extra=REFUNDS_CTE + ",\n" + DR_CTE.replace("FROM ledger", "FROM refunds")))
def q_rapid_drain_refunds(spark, sf_dir):
    led = L(spark, sf_dir)
    order, line = F.col("row_id.k1"), F.col("row_id.k2")
    return D.rapid_drain(led.withColumn("amount", F.when(line == 7, F.col("amount")).otherwise(-F.col("amount")))
                         .withColumn("sender_id", F.when(order % 3 == 0, "HOT").otherwise(F.col("sender_id"))))


@register("round_trip_counts", with_ledger("""
SELECT x.sender_id AS account_id, x.receiver_id AS counterparty, x.step AS step, x.amount AS amount,
       CAST(COUNT(*) AS BIGINT) AS n_matches, MAX(y.amount) AS match_amount,
       arg_max(y.step, (y.amount, -y.step)) AS match_step
FROM ledger x JOIN ledger y ON x.sender_id = y.receiver_id AND x.receiver_id = y.sender_id
WHERE y.step >= x.step AND y.step - x.step <= 10 AND x.amount > 0
  AND abs(x.amount - y.amount) / x.amount <= CAST(0.05 AS DOUBLE)
GROUP BY x.sender_id, x.receiver_id, x.step, x.amount, x.k1, x.k2, x.k3, x.k4""", dense=True))
def q_round_trip_counts(spark, sf_dir):
    return D.round_trip_counts(L(spark, sf_dir, dense=True)).drop("row_id")


@register("round_trip", with_ledger(sql_round_trip(), dense=True))
def q_round_trip(spark, sf_dir):
    return D.round_trip(L(spark, sf_dir, dense=True))


@register("round_trip_plain", with_ledger(sql_round_trip()))
def q_round_trip_plain(spark, sf_dir):
    return D.round_trip(L(spark, sf_dir))


@register("fan_out", with_ledger(sql_fan("out")))
def q_fan_out(spark, sf_dir):
    return D.fan_out(L(spark, sf_dir))


@register("fan_in", with_ledger(sql_fan("in")))
def q_fan_in(spark, sf_dir):
    return D.fan_in(L(spark, sf_dir))


@register("fan_out_dense", with_ledger(sql_fan("out"), dense=True))
def q_fan_out_dense(spark, sf_dir):
    return D.fan_out(L(spark, sf_dir, dense=True))


@register("amount_median", with_ledger("SELECT m AS median FROM med", extra=MEDIAN_CTE))
def q_amount_median(spark, sf_dir):
    return D.amount_median(L(spark, sf_dir))


@register("dormant_activation", with_ledger(sql_dormant(), extra=MEDIAN_CTE))
def q_dormant(spark, sf_dir):
    return D.dormant_activation(L(spark, sf_dir))


@register("high_velocity", with_ledger("""
SELECT DISTINCT account_id FROM (
  SELECT account_id, SUM(c) OVER (PARTITION BY account_id ORDER BY step
                                  RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS w
  FROM (SELECT account_id, step, COUNT(*) AS c FROM (
          SELECT sender_id AS account_id, step FROM ledger
          UNION ALL SELECT receiver_id, step FROM ledger) GROUP BY account_id, step)
) WHERE w > 8"""))
def q_high_velocity(spark, sf_dir):
    return D.high_velocity(L(spark, sf_dir))


@register("analyze", analyze_sql())
def q_analyze(spark, sf_dir):
    return A.analyze(L(spark, sf_dir)).drop("detector_seq")


@register("analyze_dense", analyze_sql(dense=True))
def q_analyze_dense(spark, sf_dir):
    return A.analyze(L(spark, sf_dir, dense=True)).drop("detector_seq")


@register("analyze_account", analyze_sql(where="sender_id = 'S1' OR receiver_id = 'S1'"))
def q_analyze_account(spark, sf_dir):
    return A.analyze(L(spark, sf_dir), account="S1").drop("detector_seq")


@register("severity_map", analyze_sql().replace(
    f"SELECT {FINDING_SQL} FROM", "SELECT pattern, confidence, CASE WHEN confidence >= 0.9 THEN "
    "'high' WHEN confidence >= 0.75 THEN 'medium' ELSE 'low' END AS severity FROM"))
def q_severity_map(spark, sf_dir):
    return A.with_severity(A.analyze(L(spark, sf_dir))).select("pattern", "confidence", "severity")


@register("findings_payload", analyze_sql().replace(
    f"SELECT {FINDING_SQL} FROM",
    "SELECT pattern AS finding_type, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= "
    "0.75 THEN 'medium' ELSE 'low' END AS severity, description, [account_id] AS account_ids, "
    "step_start, step_end, confidence, amount FROM"))
def q_findings_payload(spark, sf_dir):
    return A.to_payload(A.analyze(L(spark, sf_dir)))


# further registrations live next to their operators' families
from ledgerscope.plans import analytics as _analytics  # noqa: E402,F401
from ledgerscope.plans import casework as _casework  # noqa: E402,F401

# ------------------------------------------------------------------ many ledgers in one job
_TYPES = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]


def _analyze_cases_sql() -> str:
    parts = [f"SELECT '{t}' AS case_id, * FROM ({analyze_sql(where=f'tx_type = {chr(39)}{t}{chr(39)}')})"
             for t in _TYPES]
    return "\nUNION ALL\n".join(parts)


@register("analyze_cases", _analyze_cases_sql())
def q_analyze_cases(spark, sf_dir):
    """Every transaction type as its own case, all analysed in one job (``by``)."""
    led = L(spark, sf_dir).withColumn("case_id", F.col("tx_type"))
    return A.analyze(led, by=("case_id",)).drop("detector_seq")
from ledgerscope.plans import sql_surface as _sql_surface  # noqa: E402,F401
