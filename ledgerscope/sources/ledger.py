"""Ledger scans (A1, A2, B13) and normalisation (B1).

A ledger is a DataFrame with the eleven ``LEDGER_COLUMNS`` plus ``row_id``: an
orderable value that reproduces the input order of the rows.  ``row_id`` breaks
ties wherever the rules order rows "by step" and decides "last row wins".
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.schemas import LEDGER_COLUMNS, RAW_SCHEMA, RENAMES


#: Headers that are read at the same time.
HEADERS_AT_ONCE = 16
#: Columns that a raw log must have.
REQUIRED_RAW = ("step", "amount", "isFraud")


def _paths(paths: str | Iterable[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _csv_headers(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """URIs of the paths' files by their header line (one short read per file, some at a time)."""
    def first_row(f: str) -> list:
        return spark.read.option("header", False).csv(unquote(f)).limit(1).collect()

    out: dict[tuple[str, ...], list[str]] = {}
    files = sorted(spark.read.text(paths).inputFiles())
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        for f, first in zip(files, pool.map(first_row, files), strict=True):
            if first:
                names = [v or f"_c{i}" for i, v in enumerate(first[0])]
                out.setdefault(tuple(n.strip() for n in names), []).append(f)
    return out


def file_numbers(spark: SparkSession, files: Iterable[str]) -> DataFrame:
    """(file, _uri): the files' numbers in the order of their names; a local file's URI has one slash."""
    uris = sorted({re.sub(r"^file:/+", "file:/", f) for f in files})
    return spark.createDataFrame(list(enumerate(uris)), "file int, _uri string")


def _block_order() -> Column:
    """A long that ascends with the rows of a CSV file: a file block is read by exactly one task, and
    ids grow with the row position inside a task, so (block start, id) is the file's order.  31 bits for the
    start in units of 4 kB (blocks are larger; files up to 8 TB), 33 for the task's row number."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 12), 33).bitwiseOR(row)


def _typed(name: str, kind: T.DataType, on_bad: str) -> Column:
    """A text column as ``kind``.  Text that isn't a number is an error, or NULL (``on_bad``)."""
    raw = F.trim(F.col(f"`{name}`"))
    if isinstance(kind, T.StringType):
        return F.col(f"`{name}`")
    value = raw.try_cast("double") if isinstance(kind, T.DoubleType) else F.coalesce(
        raw.try_cast(kind), raw.try_cast("double").try_cast(kind))
    if isinstance(kind, T.IntegerType):       # flags may be written as words
        value = F.coalesce(value, raw.try_cast("boolean").cast("int"))
    if on_bad == "null":
        return value
    bad = raw.isNotNull() & (raw != "") & value.isNull() & (F.lower(raw) != "nan")
    text = F.concat(F.lit(f"malformed value in column {name}: "), raw)
    return F.when(bad, F.raise_error(text).cast(kind)).otherwise(value)


def read_csv(spark: SparkSession, paths: list[str], on_bad: str = "raise") -> DataFrame:
    """Raw CSV logs with columns taken by header name, whatever their order; further columns pass
    through as text.  Files with different headers are read separately and united by name."""
    known = {f.name: f.dataType for f in RAW_SCHEMA.fields}
    parts = []
    headers = _csv_headers(spark, paths)
    numbers = file_numbers(spark, [f for files in headers.values() for f in files])
    for names, files in headers.items():
        missing = [c for c in REQUIRED_RAW if c not in names]
        if missing:
            raise ValueError(f"raw ledger lacks required columns {missing}: {files[0]}")
        text = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.read.schema(text).option("header", True).csv([unquote(f) for f in files])
        df = df.withColumns({"_block_order": _block_order(), "_file": F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")})
        # a file that isn't in the list would lose its place: an error, not a dropped row
        df = df.join(numbers, F.col("_file") == F.col("_uri"), "left")
        number = F.coalesce("file", F.raise_error(F.concat(F.lit("unlisted file: "), F.col("_file"))).cast("int"))
        rid = F.struct(number.alias("file"), F.col("_block_order").alias("at"))
        parts.append(df.select(*[_typed(n, known.get(n, T.StringType()), on_bad).alias(n) for n in names],
                               rid.alias("row_id")))
    if not parts:
        return spark.createDataFrame([], RAW_SCHEMA).withColumn("row_id", F.lit(None).cast(
            "struct<file:int,at:bigint>"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_raw(spark: SparkSession, paths: str | Iterable[str], fmt: str = "csv",
             on_bad: str = "raise") -> DataFrame:
    """Scan raw transaction logs; adds ``row_id`` (file order).  CSV columns are matched by header
    name; a malformed number raises when it is read (``on_bad="null"`` reads it as NULL)."""
    paths = _paths(paths)
    if fmt == "csv":
        return read_csv(spark, paths, on_bad)
    if fmt == "parquet":
        df = spark.read.parquet(*paths)
        return df.withColumn("row_id", F.struct(F.col("_metadata.file_path").alias("file"),
                                                F.col("_metadata.row_index").alias("pos")))
    raise ValueError(f"unsupported ledger format: {fmt}")


def _clean_double(c: Column) -> Column:
    # NaN compares greater than everything in Spark but false in the rules: map it to NULL.
    c = c.cast("double")
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def normalize(raw: DataFrame) -> DataFrame:
    """Rename to ledger names, cast, map NaN to NULL.  Every row is kept: one without a party counts
    in the dataset-level rules, and the per-account operators leave out NULL accounts.

    Columns outside the raw layout pass through unchanged.  ``step``, ``amount`` and
    ``is_fraud`` must exist.
    """
    missing = [c for c in REQUIRED_RAW if c not in raw.columns]
    if missing:
        raise ValueError(f"raw ledger lacks required columns: {missing}")
    cols = []
    for c in raw.columns:
        name = RENAMES.get(c, c)
        col = F.col(f"`{c}`")
        if name == "step":
            col = col.cast("long")
        elif name in ("amount", "sender_balance_before", "sender_balance_after",
                      "receiver_balance_before", "receiver_balance_after"):
            col = _clean_double(col)
        elif name in ("is_fraud", "is_flagged"):
            col = col.cast("boolean")
        elif name in ("tx_type", "sender_id", "receiver_id"):
            col = col.cast("string")
        cols.append(col.alias(name))
    return raw.select(*cols)


def read_ledger(spark: SparkSession, paths: str | Iterable[str], fmt: str = "csv",
                on_bad: str = "raise") -> DataFrame:
    """A1 + B1: scan and normalise one or many transaction logs as one ledger."""
    return normalize(read_raw(spark, paths, fmt, on_bad))


def case_ledger(spark: SparkSession, paths: DataFrame, on_bad: str = "raise") -> DataFrame:
    """U4 + A2: the CSV logs of many cases (``case_id, path``) as one ledger with ``case_id``.

    A file named by several cases belongs to each of them.  The list of files is metadata and
    small; their rows are not touched on the driver.
    """
    named = paths.where(F.lower("path").endswith(".csv")).select("case_id", "path").distinct()
    listed = sorted({r["path"] for r in named.select("path").collect()})
    if not listed:
        return normalize(read_csv(spark, [])).withColumn("case_id", F.lit(None).cast("string"))
    led = read_ledger(spark, listed, on_bad=on_bad)
    numbers = file_numbers(spark, spark.read.text(listed).inputFiles())
    # Spark names a file by its URI, evidence rows by their path: the paths proper give each case the
    # numbers of its files, and rows are joined on the number
    proper = F.regexp_replace("path", r"^file:/*", "/")
    of_uri = F.url_decode(F.replace(F.regexp_replace("_uri", r"^file:/*", "/"), F.lit("+"), F.lit("%2B")))
    cases = numbers.withColumn("_path", of_uri).join(named.select("case_id", proper.alias("_path")), "_path").select(
        F.col("file").alias("_number"), "case_id")
    return led.join(cases, F.col("row_id.file") == F.col("_number")).drop("_number")


def ledger_head(ledger: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in input order (the reference's ``nrows`` sample)."""
    return ledger.orderBy("row_id").limit(n)


__all__ = ["read_raw", "read_csv", "normalize", "read_ledger", "case_ledger", "ledger_head",
           "LEDGER_COLUMNS"]
