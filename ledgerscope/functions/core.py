"""Column helpers and composed, scale-safe building blocks.

* ``money``: exact monetary arithmetic (double -> decimal, NULL on failure).
* ``severity``: B5 confidence -> high/medium/low.
* ``global_running_sum``: prefix sums in a global order without a single-partition
  window: range partitions, one total per partition, a tiny offsets table.
* ``exact_median``: exact (interpolating) median by rank selection on the
  range-partitioned value counts; never holds all values in one task.
* ``hmac_sha256``, ``canonical_json``: F15/F16 as JVM-side column expressions.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.schemas import MONEY
from ledgerscope.session import checkpoint_dir


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    return col(c).try_cast(MONEY)


def severity(conf: str | Column = "confidence") -> Column:
    """>= 0.9 high, >= 0.75 medium, else low."""
    c = col(conf)
    return F.when(c >= 0.9, "high").when(c >= 0.75, "medium").otherwise("low")


def severity_rank(sev: str | Column = "severity") -> Column:
    s = F.lower(col(sev))
    return F.when(s == "high", 3).when(s == "medium", 2).when(s == "low", 1).otherwise(0)


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def written(df: DataFrame) -> DataFrame:
    """``df``, written once as Parquet under the shared checkpoint folder and read back: a checkpoint by columns, compressed,
    whose rows may come in other partitions."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def global_running_sum(df: DataFrame, order_col: str, value_cols: list[str],
                       descending: bool = False, num_partitions: int | None = None,
                       prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<v>`` = running sum of ``v`` in global ``order_col`` order (ties: arbitrary).

    Range partitioning keeps equal keys together; each partition's total becomes a
    one-row-per-partition offsets table (bounded by the partition count, so it is
    broadcast); the running sum inside a partition is a window over that
    partition only.
    """
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    # The range bounds are sampled from the input, whose row order after a shuffle is not
    # fixed; the partitioned frame is read twice (totals, sums), so it is materialised once
    # in the shared checkpoint folder (reliable, cuts lineage, survives executor loss).
    # Without an explicit count AQE may merge neighbouring ranges, which keeps the
    # partition ids in key order.
    ranged = (df.repartitionByRange(num_partitions, order) if num_partitions
              else df.repartitionByRange(order))
    r = written(ranged.withColumn("_pid", F.spark_partition_id()))
    per = r.groupBy("_pid").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select("_pid", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}")
                                for v in value_cols])
    inner = Window.partitionBy("_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = r.join(F.broadcast(offs), "_pid")
    for v in value_cols:
        out = out.withColumn(f"{prefix}{v}", F.col(f"_o_{v}") + F.sum(v).over(inner))
    return out.drop("_pid", *[f"_o_{v}" for v in value_cols])


def _bracketed_median(known: DataFrame, value: str) -> DataFrame | None:
    """The exact median by its ranks among the values between two approximate quantiles on both sides of it:
    only these are counted by value.  None if they do not hold the middle ranks."""
    v = F.col(value)
    lo, hi = known.agg(F.percentile_approx(v, [0.49, 0.51], 2000).alias("q")).first()[0] or (None, None)
    if lo is None:
        return None
    low, high = (F.lit(x).cast(known.schema[value].dataType) for x in (lo, hi))
    side = F.when(v < low, -1).when(v > high, 1).otherwise(0)
    vc = known.groupBy(side.alias("side"), F.when(side == 0, v).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    checkpoint_dir(known.sparkSession)
    vc = vc.checkpoint()
    sides = dict(vc.groupBy("side").agg(F.sum("c")).collect())
    below, inside = sides.get(-1, 0), sides.get(0, 0)
    n = below + inside + sides.get(1, 0)
    k1, k2 = (n + 1) // 2, n // 2 + 1
    if not (below < k1 and k2 <= below + inside):
        return None
    ranked = global_running_sum(vc.where("side = 0").select("v", "c"), "v", ["c"])
    end, start = F.col("cum_c") + below, F.col("cum_c") - F.col("c") + below
    picked = [F.max(F.when((start < k) & (k <= end), F.col("v"))) for k in (k1, k2)]
    return ranked.agg(((picked[0] + picked[1]) / F.lit(2.0)).alias("median"))


#: Groups up to this number are sent to every task, a row each.
_MANY_GROUPS = 100_000


def _bracketed_medians(known: DataFrame, value: str, by: list[str]) -> DataFrame | None:
    """``_bracketed_median`` of every ``by`` group.  None if a group's values do not hold its middle ranks."""
    v = F.col(value)
    checkpoint_dir(known.sparkSession)
    cuts = known.groupBy(*by).agg(F.percentile_approx(v, [0.49, 0.51], 2000).alias("_q")).checkpoint()
    if cuts.count() > _MANY_GROUPS:
        return None
    side = F.when(v < F.col("_q")[0], -1).when(v > F.col("_q")[1], 1).otherwise(0)
    vc = known.join(F.broadcast(cuts), by).groupBy(*by, side.alias("side"), F.when(side == 0, v).alias("v")).agg(
        F.count(F.lit(1)).alias("c")).checkpoint()
    n = F.sum("c")
    sums = vc.groupBy(*by).agg(
        F.sum(F.when(F.col("side") == -1, F.col("c")).otherwise(0)).alias("_below"),
        F.sum(F.when(F.col("side") == 0, F.col("c")).otherwise(0)).alias("_inside"),
        F.floor((n + 1) / 2).alias("_k1"), (F.floor(n / 2) + 1).alias("_k2")).checkpoint()
    if not sums.where((F.col("_below") >= F.col("_k1")) | (F.col("_k2") > F.col("_below") + F.col("_inside"))).isEmpty():
        return None
    ranked = global_running_sum(vc.where("side = 0").select(*by, "v", "c", F.struct(*by, "v").alias("_k")), "_k", ["c"])
    earlier = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_off", F.coalesce(F.sum("_inside").over(earlier), F.lit(0)))
    ranked = ranked.join(F.broadcast(sums), by)
    end = F.col("cum_c") - F.col("_off") + F.col("_below")
    picked = [F.max(F.when((end - F.col("c") < k) & (k <= end), F.col("v"))) for k in (F.col("_k1"), F.col("_k2"))]
    return ranked.groupBy(*by).agg(((picked[0] + picked[1]) / F.lit(2.0)).alias("median"))


def exact_median(df: DataFrame, value: str, num_partitions: int | None = None,
                 by: tuple[str, ...] = ()) -> DataFrame:
    """Column ``median``: the interpolating median of non-NULL ``value`` (one row, or one row
    per ``by`` group).  Even counts average the two middle values; no values gives NULL.
    """
    by = list(by)
    known = df.where(F.col(value).isNotNull())
    if num_partitions is None and isinstance(df.schema[value].dataType, T.NumericType):
        if by:
            known = known.where(reduce(and_, [F.col(c).isNotNull() for c in by]))
        found = _bracketed_medians(known, value, by) if by else _bracketed_median(known, value)
        if found is not None:
            return found
    vc = known.groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    if not by:
        ranked = global_running_sum(vc, "v", ["c"], num_partitions=num_partitions)
        n = ranked.agg(F.sum("c")).scalar()  # from the materialised frame: one input pass
        k1, k2 = F.floor((n + 1) / 2), F.floor(n / 2) + 1
    else:
        # one global order over (group, value); the running count restarts per group by
        # subtracting the totals of the earlier groups (one row per group)
        ranked = global_running_sum(vc.withColumn("_k", F.struct(*by, "v")), "_k", ["c"],
                                    num_partitions=num_partitions).drop("_k")
        tot = ranked.groupBy(*by).agg(F.sum("c").alias("_n"))
        before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        tot = tot.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        ranked = ranked.join(tot, by).withColumn("cum_c", F.col("cum_c") - F.col("_off"))
        n = F.col("_n")
        k1, k2 = F.floor((n + 1) / 2), F.floor(n / 2) + 1

    def covers(k: Column) -> Column:
        return ((F.col("cum_c") - F.col("c")) < k) & (k <= F.col("cum_c"))

    picked = ranked.where(covers(k1) | covers(k2))
    med = ((F.max(F.when(covers(k1), F.col("v"))) + F.max(F.when(covers(k2), F.col("v"))))
           / F.lit(2.0)).alias("median")
    return picked.groupBy(*by).agg(med) if by else picked.agg(med)


def canonical_json(df: DataFrame, cols: list[str] | None = None) -> Column:
    """F16: JSON text of the named columns with keys in sorted order, NULLs as null, timestamps in
    UTC whatever the session's time zone."""
    names = sorted(cols if cols is not None else df.columns)
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]),
                     {"ignoreNullFields": "false", "timeZone": "UTC"})


def hmac_sha256(message: Column, key: str) -> Column:
    """hex HMAC-SHA256 of a string column under ``key`` (RFC 2104), JVM-side."""
    kb = key.encode()
    if len(kb) > 64:
        kb = hashlib.sha256(kb).digest()
    kb = kb.ljust(64, b"\x00")
    ipad = bytes(b ^ 0x36 for b in kb)
    opad = bytes(b ^ 0x5C for b in kb)
    inner = F.unhex(F.sha2(F.concat(F.lit(ipad), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(opad), inner), 256)
