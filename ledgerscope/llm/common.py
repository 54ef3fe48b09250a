"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.session import checkpoint_dir, ship_package

__all__ = ["table", "text_or_empty", "shared_folder", "checkpointed", "ship_package", "held_out"]

#: Fixed alphabet of the ASCII lower-casing (other letters keep their case).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder (every executor can reach it)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder: later reads neither recompute it
    nor depend on shuffle files of lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def held_out(doc_id: str | Column, buckets: int, bucket: int) -> Column:
    """True where crc32 of the decimal ``doc_id`` falls in the held-out bucket; a NULL id is
    held out (nothing can be learned from a row without a key)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % buckets == bucket, F.lit(True))


def blocks(texts: list[str], most: int) -> Iterator[list[int]]:
    """Row numbers in runs of at most ``most`` code points (or one text)."""
    run, size = [], 0
    for i, t in enumerate(texts):
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(i)
        size += len(t)
    if run:
        yield run


def release_memory() -> None:
    """Return freed memory to the system: Arrow and the C library keep it else, and Python workers
    stay alive beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Task) -> Task:
    """``run``, a task over record batches, that releases memory when it ends."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()
    return tidied
