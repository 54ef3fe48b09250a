"""DuckDB oracle SQL for every registered query that has one.

Each statement is written independently of the Spark code, in plain SQL over the
driver's views, and mirrors the rule it checks (often by brute force).
"""

from __future__ import annotations


def ledger_cte(dense: bool = False, name: str = "ledger") -> str:
    """The order-table ledger (see ``ledgerscope.sources.tpch``) as a CTE body."""
    cust = "(o_custkey % 50)" if dense else "o_custkey"
    supp = "(l_suppkey % 20)" if dense else "l_suppkey"
    p = "(l_extendedprice * l_quantity)"
    return f"""{name} AS (
  SELECT
    CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS step,
    CASE WHEN l_returnflag = 'R' THEN 'TRANSFER'
         WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'CASH_IN'
         WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'CASH_OUT'
         WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'DEBIT'
         WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'PAYMENT' END AS tx_type,
    {p} AS amount,
    CASE WHEN l_returnflag = 'R' THEN 'S' || CAST({supp} AS VARCHAR)
         ELSE 'C' || CAST({cust} AS VARCHAR) END AS sender_id,
    {p} * (1 + l_partkey % 20) AS sender_balance_before,
    CASE WHEN l_tax < 0.01 THEN {p} * (1 + l_partkey % 20) ELSE {p} * (l_partkey % 20) END
      AS sender_balance_after,
    CASE WHEN l_returnflag = 'R' THEN 'C' || CAST({cust} AS VARCHAR)
         ELSE 'S' || CAST({supp} AS VARCHAR) END AS receiver_id,
    {p} * l_linenumber AS receiver_balance_before,
    {p} * l_linenumber + {p} AS receiver_balance_after,
    ((l_returnflag = 'R' AND l_partkey % 20 = 0) OR (l_linenumber = 7 AND l_partkey % 97 = 0))
      AS is_fraud,
    (l_returnflag = 'R' AND {p} > 4000000) AS is_flagged,
    l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, {p} AS k5
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def with_ledger(body: str, dense: bool = False, extra: str = "", where: str | None = None) -> str:
    if where:
        ctes = ledger_cte(dense, "full_ledger") + f",\nledger AS (SELECT * FROM full_ledger WHERE {where})"
    else:
        ctes = ledger_cte(dense)
    if extra:
        ctes += ",\n" + extra
    return f"WITH {ctes}\n{body}"


# order of rows "by step" with the row tie-break
ORDER = "step, k1, k2, k3, k4, k5"
MONEY = "DECIMAL(38,6)"
