"""Ledger rows for the tests."""

from pyspark.sql import types as T

LEDGER_SCHEMA = T.StructType([
    T.StructField("step", T.LongType()),
    T.StructField("tx_type", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("sender_id", T.StringType()),
    T.StructField("sender_balance_before", T.DoubleType()),
    T.StructField("sender_balance_after", T.DoubleType()),
    T.StructField("receiver_id", T.StringType()),
    T.StructField("receiver_balance_before", T.DoubleType()),
    T.StructField("receiver_balance_after", T.DoubleType()),
    T.StructField("is_fraud", T.BooleanType()),
    T.StructField("is_flagged", T.BooleanType()),
    T.StructField("row_id", T.LongType()),
])


def make_ledger(spark, rows, partitions=None):
    """rows: dicts with any ledger columns; missing ones default; row_id = list position."""
    out = []
    for i, r in enumerate(rows):
        d = {
            "row_id": i, "step": 1, "tx_type": "TRANSFER", "amount": 0.0, "sender_id": "A",
            "sender_balance_before": None, "sender_balance_after": None, "receiver_id": "B",
            "receiver_balance_before": None, "receiver_balance_after": None,
            "is_fraud": False, "is_flagged": False,
        }
        d.update(r)
        out.append(tuple(d[f.name] for f in LEDGER_SCHEMA.fields))
    df = spark.createDataFrame(out, LEDGER_SCHEMA)
    return df.repartition(partitions) if partitions else df
