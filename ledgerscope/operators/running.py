"""Running medians of every group's earlier values, for groups of any size.

The rows are range-sorted by (group, order), so a block of a partition's rows is a chunk of the history of one
or many groups, of bounded size however large the partition is, and a group that holds a third of all rows is just many chunks.

* A group that begins in a chunk needs nothing else there: one wavelet matrix over the
  chunk's values answers all of its rows (any stretch of the chunk, any rank).
* A group that goes on from earlier chunks is cut by value, too: its values are range-sorted
  into buckets, counted per (chunk, bucket), and the counts of earlier chunks summed up.  Chunk by
  chunk, these sums and the chunk's own earlier rows say in which bucket the middle
  values of each row lie and at which place of it; (chunk, bucket) by (chunk, bucket), the bucket's
  earlier rows give the value.

A task holds one chunk or one bucket, never a group.  The middle of a long history moves by at
most one value per two rows, so all chunks together ask for about as many buckets as there are chunks
(times a logarithm); a bucket is sent once to each chunk that asks for it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.functions.wavelet import nth_smallest, ranks
from ledgerscope.session import checkpoint_dir, ship_package

_ASKED = "_pid long, _bucket long, _at long, _t long, _half double"
#: Rows of a chunk: a partition is worked on in blocks of about so many, each a chunk.
_CHUNK = 1 << 17
_FOUND = "_pid long, _at long, _part double"


def _floats(col) -> np.ndarray:
    """Values with NaN for NULL."""
    return np.asarray(col.to_numpy(zero_copy_only=False) if isinstance(col, pa.Array) else col.to_numpy(), np.float64)


def _middles(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, rank, weight) of the one or two middle values of k > 0 values."""
    rows = np.flatnonzero(k > 0)
    even = rows[k[rows] % 2 == 0]
    odd = rows[k[rows] % 2 == 1]
    row = np.concatenate([odd, even, even])
    rank = np.concatenate([(k[odd] - 1) // 2, k[even] // 2 - 1, k[even] // 2])
    return row, rank, np.concatenate([np.ones(len(odd)), np.full(2 * len(even), 0.5)])


def medians_before(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each row, the median of the non-NaN values from its group's first row ``starts`` up to the row
    before (NaN: none); two middle values give half of each."""
    known = ~np.isnan(values)
    seen = np.concatenate([[0], np.cumsum(known)])
    rank, ordered = ranks(values[known])
    lo, hi = seen[starts], seen[:-1]
    row, t, weight = _middles(hi - lo)
    out = np.full(len(values), np.nan)
    out[row] = 0.0
    if len(row):
        at, _ = nth_smallest(rank, lo[row], hi[row], t)
        np.add.at(out, row, weight * ordered[at])
    return out


def _counts_within(starts: np.ndarray, steps: np.ndarray, span: int) -> np.ndarray:
    """For each row (by group, then step), the rows of its group with a step in [step - span, step - 1]."""
    code = np.cumsum(np.concatenate([[False], starts[1:] != starts[:-1]]))
    width = int(steps.max()) - int(steps.min()) + span + 1
    if width * (int(code[-1]) + 1) < 1 << 62:
        key = code * width + (steps - steps.min() + span)
        return np.searchsorted(key, key) - np.maximum(np.searchsorted(key, key - span), starts)
    bounds = [*np.unique(starts), len(steps)]
    return np.concatenate([np.searchsorted(s, s) - np.searchsorted(s, s - span)
                           for s in (steps[a:b] for a, b in zip(bounds, bounds[1:]))])


def running_median(df: DataFrame, group: str, order: list[str], value: str, name: str,
                   num_partitions: int | None = None, recent: tuple[str, int, str] | None = None,
                   chunk_rows: int = _CHUNK) -> DataFrame:
    """``df`` with ``name``: the median of ``value`` over the rows of the same ``group`` that come earlier
    by ``order`` (a total order), NULL where there are none.  NULL and NaN values don't count.

    ``recent`` (step, span, column): also the number of rows of the group with a step in
    [step - span, step - 1]; ``order`` begins with that step, a whole number without NULLs.

    The sorted rows are written once to the shared checkpoint folder.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    ship_package(spark)
    columns = df.columns
    by = [F.col(group), *[F.col(c) for c in order]]
    ranged = df.repartitionByRange(num_partitions, *by) if num_partitions else df.repartitionByRange(*by)
    ranged = ranged.sortWithinPartitions(*by).select(
        *columns, F.col(value).cast("double").alias("_value"), F.col(group).alias("_group"),
        F.spark_partition_id().cast("long").alias("_pid"))
    counted = f", {recent[2]} long" if recent else ""
    # the group and a value that is a double are columns of the rows: written once
    again = df.schema[value].dataType != T.DoubleType()
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(
        f"{'_value double, ' if again else ''}_pid long, _at long, {name} double{counted}").fields])
    names, width = schema.names, len(columns)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, chunk_rows):
                held.append(b.slice(at, chunk_rows))
                n += held[-1].num_rows
                if n >= chunk_rows:
                    yield held
                    held, n = [], 0
        if held:
            yield held

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in enumerate(blocks(batches)):
            whole = pa.Table.from_batches([pa.RecordBatch.from_arrays([b.column(i) for i in wanted], [str(i) for i in wanted]) for b in rows])
            codes = whole.column(str(width + 1)).combine_chunks().dictionary_encode()
            codes = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new = np.ones(len(codes), bool)
            new[1:] = codes[1:] != codes[:-1]
            starts = np.flatnonzero(new)[np.cumsum(new) - 1]
            median = medians_before(_floats(whole.column(str(width))), starts)
            near = _counts_within(starts, whole.column(str(wanted[2])).to_numpy().astype(np.int64), recent[1]) if recent else None
            pid = (rows[0].column(width + 2)[0].as_py() << 24) + number
            at = 0
            for b in rows:
                end = at + b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:width], *([b.column(width)] if again else []), pa.array(np.full(b.num_rows, pid), pa.int64()),
                     pa.array(np.arange(at, end), pa.int64()), pa.array(median[at:end], pa.float64(), from_pandas=True),
                     *([pa.array(near[at:end], pa.int64())] if recent else [])], names)
                at = end

    wanted = [width, width + 1, *([columns.index(recent[0])] if recent else [])]
    path = f"{checkpoint_dir(spark).rstrip('/')}/sorted-{uuid.uuid4().hex}"
    ranged.mapInArrow(chunk, schema).write.option("compression", "zstd").parquet(path)
    done = spark.read.schema(schema).parquet(path).withColumn("_group", F.col(group))
    done = done if again else done.withColumn("_value", F.col(value))
    # groups at the edges of chunks: at most two rows per chunk
    edges = done.groupBy("_pid").agg(F.min_by("_group", "_at").alias("first"), F.max_by("_group", "_at").alias("last"))
    in_order = Window.orderBy("_pid")
    on = edges.select("_pid", "first", F.lag("last").over(in_order).alias("previous"), F.lag("_pid").over(in_order).alias("_before"))
    on = on.where(F.col("_before").isNotNull() & F.col("previous").eqNullSafe(F.col("first")))
    on = on.select("_pid", F.col("first").alias("_group")).checkpoint()
    made = [name, *([recent[2]] if recent else [])]
    if on.isEmpty():
        return done.select(*columns, *made)
    continued = F.broadcast(on.select("_pid", F.col("_group").alias("_g"), F.lit(True).alias("_on")))
    marked = done.join(continued, (done["_pid"] == continued["_pid"]) & done["_group"].eqNullSafe(continued["_g"]),
                       "left").select(done["*"], F.coalesce("_on", F.lit(False)).alias("_on"))
    found = _continued(done, on, group_rows=marked.where("_on"))
    open_rows = marked.where("_on").drop(*made).join(found, ["_pid", "_at"], "left").withColumn(name, F.col("_median"))
    if recent:
        step, span, column = recent
        groups = F.broadcast(on.select(F.col("_group").alias("_g")).distinct())
        cells = done.join(groups, done["_group"].eqNullSafe(groups["_g"])).groupBy("_g", F.col(step).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
        near = Window.partitionBy("_g").orderBy("_s").rangeBetween(-span, -1)
        cells = cells.select("_g", "_s", F.coalesce(F.sum("_c").over(near), F.lit(0)).alias(column))
        open_rows = open_rows.join(cells, F.col("_group").eqNullSafe(F.col("_g")) & (F.col(step) == F.col("_s")))
    return marked.where(~F.col("_on")).select(*columns, *made).unionByName(open_rows.select(*columns, *made))


def _continued(done: DataFrame, on: DataFrame, group_rows: DataFrame) -> DataFrame:
    """(_pid, _at, _median) of the rows of groups that go on from earlier chunks."""
    groups = F.broadcast(on.select(F.col("_group").alias("_g")).distinct())
    spans = done.join(groups, done["_group"].eqNullSafe(groups["_g"])).where(
        F.col("_value").isNotNull() & ~F.isnan("_value")).select("_group", "_pid", "_at", "_value")
    pieces = max(1, -(-spans.count() // _CHUNK))
    valued = spans.repartitionByRange(pieces, "_group", "_value", "_pid", "_at").withColumn(
        "_bucket", F.spark_partition_id().cast("long")).checkpoint()
    cells = valued.groupBy("_group", "_bucket", "_pid").agg(F.count(F.lit(1)).alias("n"))
    # every later chunk of a group with every bucket of it: as many rows as chunks times buckets
    chunks = on.select(F.col("_group").alias("_g"), F.col("_pid").alias("_p"))
    buckets = cells.select("_group", "_bucket").distinct()
    grid = buckets.join(chunks, F.col("_group").eqNullSafe(F.col("_g"))).select("_group", "_bucket", F.col("_p").alias("_pid"))
    either = cells.unionByName(grid.withColumn("n", F.lit(None).cast("long")))
    summed = either.groupBy("_group", "_bucket", "_pid").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.bool_or(F.col("n").isNull()).alias("asked"))
    earlier = Window.partitionBy("_group", "_bucket").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = summed.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where("asked").select(
        F.col("_pid").alias("_chunk"), F.col("_bucket").alias("_of"), "before")

    own = group_rows.select("_pid", "_at", "_value", "_group")
    placed = own.join(valued.select("_pid", "_at", "_bucket"), ["_pid", "_at"], "left").select(
        "_pid", "_at", F.coalesce("_bucket", F.lit(-1).cast("long")).alias("_bucket"))

    def ask(rows: pa.Table, counts: pa.Table) -> pa.Table:
        at, bucket = rows.column("_at").to_numpy(), rows.column("_bucket").to_numpy()
        order = np.argsort(at)
        at, bucket = at[order], bucket[order]
        ids = np.sort(counts.column("_of").to_numpy())
        past = counts.column("before").to_numpy()[np.argsort(counts.column("_of").to_numpy())]
        known = bucket >= 0
        seen = np.concatenate([[0], np.cumsum(known)])[:-1]
        row, t, weight = _middles(seen + int(past.sum()))
        hit, place = nth_smallest(np.searchsorted(ids, bucket[known]), np.zeros(len(row)), seen[row], t, past)
        pid = np.full(len(row), rows.column("_pid")[0].as_py())
        return pa.table([pa.array(x) for x in (pid, ids[hit], at[row], place, weight)],
                        ["_pid", "_bucket", "_at", "_t", "_half"])

    asked = placed.groupBy("_pid").cogroup(before.groupBy("_chunk")).applyInArrow(ask, _ASKED).checkpoint()
    # a chunk asks about one group, its first
    wanted = asked.select("_pid", "_bucket").distinct().join(F.broadcast(on), "_pid").select(
        F.col("_pid").alias("_asker"), F.col("_bucket").alias("_b"), F.col("_group").alias("_g"))
    sent = valued.join(wanted, (valued["_bucket"] == F.col("_b")) & valued["_group"].eqNullSafe(F.col("_g"))
                       & (valued["_pid"] <= F.col("_asker"))).select(
        "_asker", "_bucket", valued["_pid"].alias("_from"), "_at", "_value")

    def answer(questions: pa.Table, rows: pa.Table) -> pa.Table:
        pid = questions.column("_pid")[0].as_py() if questions.num_rows else 0
        value = rows.column("_value").to_numpy()
        order = np.lexsort((rows.column("_at").to_numpy(), rows.column("_from").to_numpy()))
        value, source, at = value[order], rows.column("_from").to_numpy()[order], rows.column("_at").to_numpy()[order]
        rank, ordered = ranks(value)
        earlier_rows = int(np.searchsorted(source, pid))
        end = earlier_rows + np.searchsorted(at[earlier_rows:], questions.column("_at").to_numpy())
        hit, _ = nth_smallest(rank, np.zeros(len(end)), end, questions.column("_t").to_numpy())
        return pa.table([questions.column("_pid"), questions.column("_at"),
                         pa.array(ordered[hit] * questions.column("_half").to_numpy())], ["_pid", "_at", "_part"])

    parts = asked.groupBy("_pid", "_bucket").cogroup(sent.groupBy("_asker", "_bucket")).applyInArrow(answer, _FOUND)
    return parts.groupBy("_pid", "_at").agg(F.sum("_part").alias("_median"))
