"""Declared schemas of every table the library reads or writes."""

from pyspark.sql import types as T

# Source column names of a raw transaction log (fixed values: the PaySim layout).
RAW_SCHEMA = T.StructType([
    T.StructField("step", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("nameOrig", T.StringType()),
    T.StructField("oldbalanceOrg", T.DoubleType()),
    T.StructField("newbalanceOrig", T.DoubleType()),
    T.StructField("nameDest", T.StringType()),
    T.StructField("oldbalanceDest", T.DoubleType()),
    T.StructField("newbalanceDest", T.DoubleType()),
    T.StructField("isFraud", T.IntegerType()),
    T.StructField("isFlaggedFraud", T.IntegerType()),
])

# Raw name -> ledger name (fixed values).
RENAMES = {
    "step": "step",
    "type": "tx_type",
    "amount": "amount",
    "nameOrig": "sender_id",
    "oldbalanceOrg": "sender_balance_before",
    "newbalanceOrig": "sender_balance_after",
    "nameDest": "receiver_id",
    "oldbalanceDest": "receiver_balance_before",
    "newbalanceDest": "receiver_balance_after",
    "isFraud": "is_fraud",
    "isFlaggedFraud": "is_flagged",
}

# Ledger column names in order (fixed values).
LEDGER_COLUMNS = [
    "step", "tx_type", "amount", "sender_id", "sender_balance_before", "sender_balance_after",
    "receiver_id", "receiver_balance_before", "receiver_balance_after", "is_fraud", "is_flagged",
]

# Transaction types of the one-hot features (fixed values).
TX_TYPES = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]

FINDING_SCHEMA = T.StructType([
    T.StructField("pattern", T.StringType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("step_start", T.LongType()),
    T.StructField("step_end", T.LongType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("description", T.StringType()),
])
FINDING_COLUMNS = [f.name for f in FINDING_SCHEMA.fields]

# Times from which on a case's findings count.
RESET_SCHEMA = T.StructType([
    T.StructField("case_id", T.StringType()), T.StructField("at", T.TimestampType())])

# Generations of the stored findings.
COMMIT_SCHEMA = T.StructType([
    T.StructField("generation", T.LongType()), T.StructField("at", T.TimestampType())])

# Stored names of findings, cases and evidence (fixed values).
STORED_FINDING_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("case_id", T.StringType()),
    T.StructField("finding_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("account_ids", T.ArrayType(T.StringType())),
    T.StructField("step_start", T.LongType()),
    T.StructField("step_end", T.LongType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
])

CASE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("investigator", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
])

EVIDENCE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("case_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("sha256_hash", T.StringType()),
    T.StructField("md5_hash", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("acquired_at", T.TimestampType()),
    T.StructField("notes", T.StringType()),
])

EVENT_COLUMNS = ["account_id", "step", "event_type", "amount", "counterparty", "balance_before",
                 "balance_after", "annotation", "is_flagged"]

# Feature names in model-input order (fixed values).
FEATURE_COLUMNS = [
    "amount",
    "tx_type_CASH_IN",
    "tx_type_CASH_OUT",
    "tx_type_DEBIT",
    "tx_type_PAYMENT",
    "tx_type_TRANSFER",
    "balance_change_ratio",
    "sender_drained",
    "balance_mismatch",
    "receiver_prior_tx_count",
    "sender_tx_velocity",
    "amount_vs_sender_median",
    "hour_of_day",
]

# Money is summed exactly in this type, then reported as double.
MONEY = "decimal(38,6)"
