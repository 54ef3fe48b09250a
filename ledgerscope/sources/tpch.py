"""Ledger adapter over the driver's order tables (``lineitem`` joined to ``orders``).

Each line item becomes one transaction.  The mapping (fixed values, shared with
the DuckDB oracle in ``ledgerscope.plans.oracle``):

* step: whole days from 1995-01-01 to ``l_shipdate``
* tx_type: R -> TRANSFER; A+F -> CASH_IN; A+O -> CASH_OUT; N+F -> DEBIT; N+O -> PAYMENT
  (``l_returnflag`` + ``l_linestatus``)
* amount P = ``l_extendedprice * l_quantity``
* returns (R) flow supplier -> customer, everything else customer -> supplier
* sender balance before = P * (1 + l_partkey % 20); after = before when
  ``l_tax < 0.01`` else P * (l_partkey % 20)
* receiver balance before = P * l_linenumber; after = before + P
* is_fraud = (R and l_partkey % 20 = 0) or (l_linenumber = 7 and l_partkey % 97 = 0)
* is_flagged = R and P > 4000000
* row_id = (l_orderkey, l_linenumber, l_partkey, l_suppkey, amount)

``dense=True`` folds customers mod 50 and suppliers mod 20 so that accounts are hot and
pairs repeat (round trips, skew).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1995-01-01"


def order_ledger(spark: SparkSession, sf_dir: str, dense: bool = False,
                 steps: tuple[int, int] | None = None) -> DataFrame:
    """``steps=(lo, hi)`` restricts to that inclusive step range as a ship-date range on
    ``lineitem`` itself, so the scan skips row groups (the step is computed, so a filter
    on it alone cannot be pushed)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    if steps is not None:
        epoch = F.lit(EPOCH).cast("date")
        li = li.where((F.col("l_shipdate") >= F.date_add(epoch, steps[0]).cast("timestamp"))
                      & (F.col("l_shipdate") < F.date_add(epoch, steps[1] + 1).cast("timestamp")))
    od = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    # what can be worked out from the line alone is, so that the join carries few and narrow columns
    p = F.col("p")
    ret = F.col("ret")
    li = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_extendedprice") * F.col("l_quantity")).alias("p"),
        "l_returnflag", "l_linestatus", (F.col("l_returnflag") == "R").alias("ret"), (F.col("l_tax") < 0.01).alias("kept"),
        F.datediff(F.to_date("l_shipdate"), F.lit(EPOCH).cast("date")).cast("long").alias("step"))
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")

    cust = (F.col("o_custkey") % 50) if dense else F.col("o_custkey")
    supp = (F.col("l_suppkey") % 20) if dense else F.col("l_suppkey")
    c_id = F.concat(F.lit("C"), cust.cast("string"))
    s_id = F.concat(F.lit("S"), supp.cast("string"))
    pk20 = F.col("l_partkey") % 20
    before = p * (F.lit(1) + pk20)
    tx_type = (F.when(ret, "TRANSFER")
               .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "CASH_IN")
               .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "CASH_OUT")
               .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "DEBIT")
               .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "PAYMENT"))
    return j.select(
        "step",
        tx_type.alias("tx_type"),
        p.alias("amount"),
        F.when(ret, s_id).otherwise(c_id).alias("sender_id"),
        before.alias("sender_balance_before"),
        F.when(F.col("kept"), before).otherwise(p * pk20).alias("sender_balance_after"),
        F.when(ret, c_id).otherwise(s_id).alias("receiver_id"),
        (p * F.col("l_linenumber")).alias("receiver_balance_before"),
        (p * F.col("l_linenumber") + p).alias("receiver_balance_after"),
        ((ret & (pk20 == 0)) | ((F.col("l_linenumber") == 7) & (F.col("l_partkey") % 97 == 0)))
        .alias("is_fraud"),
        (ret & (p > 4000000)).alias("is_flagged"),
        F.struct(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"),
                 F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"),
                 p.alias("k5")).alias("row_id"),
    )


def raw_order_log(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """The same transactions in the raw log layout (PaySim column names), for ``normalize``."""
    from ledgerscope.schemas import RENAMES
    led = order_ledger(spark, sf_dir, dense)
    cols = [(F.col(name).cast("int") if raw in ("isFraud", "isFlaggedFraud") else F.col(name))
            .alias(raw) for raw, name in RENAMES.items()]
    return led.select(*cols, "row_id")
