"""The corpus pipeline: documents to packed training sequences.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import shared_folder, table
from ledgerscope.llm.mixing import mixed_documents
from ledgerscope.llm.neardup import keep_first
from ledgerscope.llm.packing import pack
from ledgerscope.llm.quality import keep_good
from ledgerscope.llm.toxicity import keep_clean


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the span tagger doesn't call toxic."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair schedule; smaller sources repeat (epochs)."""
    return mixed_documents(docs)


def in_file_order(docs: DataFrame) -> DataFrame:
    """The rows of a written table in the order in which they were written: by number of the part
    file and row in it.  Reading alone deals files out by size.  A table that isn't read from
    files, but for filters and selections, has its order already."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Filter", "Project"):        # these leave the rows' order alone
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return docs
    path = F.col("_metadata.file_path")
    part = F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).try_cast("long")
    # the row travels as one struct, so its columns can't clash with the order's
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.struct(
        part.alias("part"), path.alias("path"), F.col("_metadata.row_index").alias("row")).alias("_written"))
    return keyed.repartitionByRange("_written").sortWithinPartitions("_written").select("_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their token ids; ``sequence_id`` follows the mixture."""
    return pack(in_file_order(docs))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates),
          ("mixture", mixture), ("packing", packing)]

#: The taggers and signatures can't be expressed in SQL; the tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is kept in the shared folder, so a lost
    executor never costs more than the stage that is running."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
