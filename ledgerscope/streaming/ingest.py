"""Incremental ledger ingest with Structured Streaming.

The reference only reads complete files; it has no event-time, watermark or state
logic.  The one streaming form that keeps its semantics is ingest: raw transaction
logs dropped into a folder are normalised (A1 + B1) and appended to a Parquet ledger
table, exactly once per file, with progress kept in a checkpoint location on shared
storage.  Detection then runs as a batch over that table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerscope.schemas import RAW_SCHEMA
from ledgerscope.session import checkpoint_dir
from ledgerscope.sources.ledger import normalize


def raw_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Raw CSV logs appearing in ``folder`` as a stream, with their file and block.  A stream has
    one fixed layout: a file whose header names other columns or another order is an error, and so
    is a malformed number."""
    df = (spark.readStream.schema(RAW_SCHEMA).option("header", True)
          .option("enforceSchema", False).option("mode", "FAILFAST")
          .option("maxFilesPerTrigger", max_files_per_trigger).csv(folder))
    return df.withColumns({"_file": F.col("_metadata.file_path"),
                           "_block": F.col("_metadata.file_block_start")})


def _write_batch(table_path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # row position inside the micro-batch (a batch DataFrame); a file block is read by
        # one task, so (file, block, pos) is the file order
        rows = batch.withColumn("row_id", F.struct(
            F.col("_file").alias("file"), F.col("_block").alias("block"),
            F.monotonically_increasing_id().alias("pos"))).drop("_file", "_block")
        out = normalize(rows).withColumn("ingest_batch", F.lit(batch_id))
        # a retried batch overwrites its own partition: exactly-once output
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("ingest_batch").parquet(table_path))
    return write


def ingest(spark: SparkSession, folder: str, table_path: str,
           checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """Normalise new files of ``folder`` into the Parquet ledger at ``table_path``.

    ``once=True`` processes what is there and stops (``availableNow``); otherwise the
    query keeps running.  The checkpoint defaults to a folder under the session's
    shared checkpoint directory.
    """
    tag = hashlib.sha256(table_path.encode()).hexdigest()[:16]  # stable across restarts
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/ingest-{tag}"
    w = (raw_stream(spark, folder).writeStream.foreachBatch(_write_batch(table_path))
         .option("checkpointLocation", ckpt))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")
    return w.start()


def read_ingested(spark: SparkSession, table_path: str) -> DataFrame:
    """The ingested ledger as a batch DataFrame."""
    return spark.read.parquet(table_path).drop("ingest_batch")
