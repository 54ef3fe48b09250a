"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Each source's documents, in key order, form a stream that is cut into blocks of ``block_chars``
code points (a document belongs to the block it starts in).  With target weights q_i / Q
(integers with sum Q), the j-th block of source i has release time floor((j - 1) Q / q_i) and
deadline ceil(j Q / q_i); one block is served per slot, the released one with the earliest
deadline.  As the weights add up to one, every block meets its window, so at any time t source i
has been served t q_i / Q blocks with a deviation of less than one block.

The windows repeat every Q slots, so the schedule of one period (a table of Q rows) places every
block of every source: no global queue, no task that sees a whole source.  The stream ends when
each source has been served once in full; smaller sources repeat until then, at most
``max_epochs`` times (after that their slots stay empty).

Target weights: given, or proportional to (code points of the source) ** ``temperature``.

Defined cases: NULL text has length 0; every text counts one code point more than it has, so
each document advances its stream.  A NULL source is a source of its own.  Rows that are equal
in key, source and text are scheduled together, each of them.  Sources without a given weight, or
with one that isn't positive, aren't scheduled.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.core import global_running_sum
from ledgerscope.llm.common import checkpointed, text_or_empty

BLOCK_CHARS, TEMPERATURE, MAX_EPOCHS, PERIOD = 8192, 0.9, 4, 1000


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def units(docs: DataFrame) -> DataFrame:
    """Narrow rows ``doc_id, source, src, h, copies, size``: one per distinct (key, source, text)."""
    t = text_or_empty("text")
    n = docs.select("doc_id", "source", source_key(F.col("source")).alias("src"),
                    F.xxhash64(t).alias("h"), (F.length(t) + 1).cast("long").alias("size"))
    return (n.groupBy("doc_id", "source", "src", "h", "size")
            .agg(F.count(F.lit(1)).alias("copies"))
            .withColumn("size", F.col("size") * F.col("copies")))


def quotas(totals: DataFrame, period: int, temperature: float, weights: DataFrame | None) -> DataFrame:
    """``src, idx, q``: whole slots of a period per source, every source at least one, the rest
    by largest remainders.  ``weights``: (source, weight), else powers of the totals."""
    if weights is None:
        w = totals.select("src", F.pow(F.col("total").cast("double"), F.lit(temperature)).alias("w"))
    else:
        w = totals.join(weights.select(source_key(F.col("source")).alias("src"),
                                       F.col("weight").cast("double").alias("w")), "src").select("src", "w")
        w = w.where(F.col("w") > 0)
    every = Window.partitionBy(F.lit(0))                     # one row per source
    spare = period - F.count(F.lit(1)).over(every)
    share = F.round(F.col("w") / F.sum("w").over(every) * spare, 6)
    d = w.select("src", share.alias("share"), spare.alias("spare"))
    rank = F.row_number().over(every.orderBy((F.col("share") - F.floor("share")).desc(), "src"))
    left = F.col("spare") - F.sum(F.floor("share")).over(every)
    return d.select("src", F.row_number().over(every.orderBy("src")).alias("idx"),
                    (1 + F.floor("share") + F.when(rank <= left, 1).otherwise(0)).cast("long").alias("q"))


def schedule(quota: DataFrame, period: int) -> DataFrame:
    """Earliest-deadline-first over one period: ``src, q, j, slot`` with j = 1..q per source."""
    one = quota.agg(F.array_sort(F.collect_list(F.struct("idx", "src", "q"))).alias("s")).where(F.size("s") > 0)
    big = F.lit(period).cast("long")

    def slot(state: Column, t: Column) -> Column:
        ready = F.zip_with(state["sources"], state["served"], lambda s, n: F.when(
            F.floor(n * big / s["q"]) <= t,
            F.struct(F.ceil((n + 1) * big / s["q"]).alias("deadline"), s["idx"].alias("idx"))))
        pick = F.array_min(ready)["idx"]                     # NULLs (not released) are left out
        served = F.transform(state["served"], lambda n, i: F.when(i + 1 == pick, n + 1).otherwise(n))
        return F.struct(state["sources"].alias("sources"), served.alias("served"),
                        F.concat(state["order"], F.array(F.struct(
                            F.element_at(state["sources"], pick)["src"].alias("src"),
                            F.element_at(state["sources"], pick)["q"].alias("q"),
                            F.element_at(served, pick).alias("j")))).alias("order"))

    begin = F.struct(
        F.col("s").alias("sources"), F.transform("s", lambda x: F.lit(0).cast("long")).alias("served"),
        F.array().cast("array<struct<src:string,q:bigint,j:bigint>>").alias("order"))
    order = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(period - 1).cast("long")), begin, slot,
                        lambda s: s["order"])
    return one.select(F.posexplode(order).alias("slot", "x")).select(
        "x.src", "x.q", "x.j", F.col("slot").cast("long").alias("slot"))


def mix(docs: DataFrame, weights: DataFrame | None = None, block_chars: int = BLOCK_CHARS,
        temperature: float = TEMPERATURE, max_epochs: int = MAX_EPOCHS, period: int = PERIOD) -> DataFrame:
    """Every scheduled unit: ``doc_id, source, h, copies, epoch, block`` (from 1, in the source's
    stream over all epochs), ``release, deadline, slot`` (global slot numbers from 0).

    A period has at least four slots per source, so the period's tables have at most
    max(period, 4 x sources) rows.
    """
    u = units(docs).withColumn("_o", F.struct("src", F.col("doc_id").isNotNull(), "doc_id", "h"))
    run = checkpointed(global_running_sum(u, "_o", ["size"], prefix="to_").drop("_o"))
    totals = run.groupBy("src").agg(F.sum("size").alias("total"), F.max("to_size").alias("upto"))
    totals = checkpointed(totals)                            # one row per source
    slots = max(period, 4 * totals.count())
    quota = quotas(totals, slots, temperature, weights)
    plan = checkpointed(schedule(quota, slots))
    n_blocks = F.ceil(F.col("total") / F.lit(block_chars)).cast("long")
    src = (totals.join(plan.select("src", "q").distinct(), "src")
           .select("src", "q", n_blocks.alias("n_blocks"), (F.col("upto") - F.col("total")).alias("before")))
    at = F.floor((F.col("n_blocks") - 1) / F.col("q")) * slots
    nth = F.pmod(F.col("n_blocks") - 1, F.col("q")) + 1
    last = (src.withColumn("j", nth).join(plan.select("src", "j", "slot"), ["src", "j"])
            .agg(F.max(at + F.col("slot")))).scalar()        # slot in which the last first pass ends
    placed = run.join(F.broadcast(src), "src").withColumn(
        "_k", F.floor((F.col("to_size") - F.col("size") - F.col("before")) / F.lit(block_chars)).cast("long"))
    most = F.floor((F.floor(last / slots) * F.col("q") + F.col("q") - 1 - F.col("_k")) / F.col("n_blocks"))
    rows = placed.select("doc_id", "source", "src", "h", "copies", "q", "n_blocks", "_k", F.explode(
        F.sequence(F.lit(0).cast("long"), F.least(most, F.lit(max_epochs - 1)).cast("long"))).alias("epoch"))
    b = F.col("_k") + F.col("epoch") * F.col("n_blocks")     # number of the block in the stream, from 0
    rows = rows.withColumn("_b", b).withColumn("j", F.pmod(F.col("_b"), F.col("q")) + 1)
    rows = rows.join(F.broadcast(plan.select("src", "j", F.col("slot").alias("_s"))), ["src", "j"])
    start = F.floor(F.col("_b") / F.col("q")) * slots
    slot = (start + F.col("_s")).cast("long")
    return rows.where(slot <= last).select(
        "doc_id", "source", "h", "copies", (F.col("epoch") + 1).alias("epoch"),
        (F.col("_b") + 1).alias("block"),
        (start + F.floor((F.col("j") - 1) * slots / F.col("q"))).cast("long").alias("release"),
        (start + F.ceil(F.col("j") * slots / F.col("q"))).cast("long").alias("deadline"),
        slot.alias("slot"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (same columns) in the order of the mixture, repeated by epoch: range
    partitions by slot, sorted inside."""
    plan = mix(docs, **options).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                                       F.col("h").alias("_h"), F.col("slot").alias("_slot"))
    # the row travels as one struct, so its columns can't clash with the plan's
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(text_or_empty("text")).alias("_t"))
    on = (F.col("_row.doc_id").eqNullSafe(F.col("_id")) & F.col("_row.source").eqNullSafe(F.col("_source"))
          & (F.col("_t") == F.col("_h")))
    return (rows.join(plan, on).repartitionByRange("_slot", "_id", "_h")
            .sortWithinPartitions("_slot", "_id", "_h").select("_row.*"))
