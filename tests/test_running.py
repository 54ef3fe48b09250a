"""Running medians: chunks against plain sorting."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.functions.wavelet import nth_smallest
from ledgerscope.operators.running import medians_before, running_median

COLS = "g string, step long, id long, amount double, note string"


def plain(rows):
    out, seen = {}, {}
    for g, step, i, v, _ in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        got = seen.setdefault(g, [])
        out[i] = statistics.median(got) if got else None
        if v is not None and v == v:
            got.append(v)
    return out


def make(seed, n, values):
    rnd = random.Random(seed)
    return [(rnd.choice(["HOT"] * 4 + ["WARM"] * 2 + [f"g{rnd.randrange(40)}", None]), rnd.randrange(30), i,
             rnd.choice([None, float("nan")] if rnd.random() < 0.1 else values), "x") for i in range(n)]


@pytest.mark.parametrize("seed,n,parts", [(1, 300, 1), (2, 900, 7), (3, 900, 40), (4, 60, 30)])
def test_medians_equal_sorting(spark, seed, n, parts):
    values = [1.0, 2.0, 2.0, -3.0, 5.5, 8.0, 1e9] if seed % 2 else [random.Random(seed).gauss(0, 1) for _ in range(500)]
    rows = make(seed, n, values)
    df = spark.createDataFrame(rows, COLS).repartition(5)
    out = running_median(df, "g", ["step", "id"], "amount", "med", parts)
    assert out.columns == [*df.columns, "med"]
    got = {r["id"]: r["med"] for r in out.collect()}
    assert got == plain(rows)


def test_rising_values_ask_for_ever_new_buckets(spark):
    """The middle moves through all buckets."""
    rows = [("HOT", i, i, float(i), None) for i in range(600)]
    got = {r["id"]: r["med"] for r in running_median(spark.createDataFrame(rows, COLS), "g", ["step", "id"], "amount", "med", 12).collect()}
    assert got == {i: None if i == 0 else (i - 1) / 2 for i in range(600)}


def test_no_rows_and_no_values(spark):
    empty = spark.createDataFrame([], COLS)
    assert running_median(empty, "g", ["step", "id"], "amount", "med").count() == 0
    rows = [("a", 1, i, None, None) for i in range(50)]
    got = running_median(spark.createDataFrame(rows, COLS), "g", ["step", "id"], "amount", "med", 9).collect()
    assert len(got) == 50 and {r["med"] for r in got} == {None}


def test_no_task_holds_a_hot_group(spark):
    """A third of the rows is one sender's: chunks of the sorted rows stay even."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("s"), F.col("id") % 5000)).alias("g"),
        (F.hash("id") % 100).cast("long").alias("step"), "id", (F.hash("id", F.lit(7)) % 1000).cast("double").alias("amount"),
        F.lit("n").alias("note"))
    sizes = [r["count"] for r in df.repartitionByRange(12, "g", "step", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * statistics.median(sizes)
    plan = running_median(df, "g", ["step", "id"], "amount", "med", 12)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan
    rows = [tuple(r) for r in df.collect()]
    got = {r["id"]: r["med"] for r in running_median(df, "g", ["step", "id"], "amount", "med", 12).collect()}
    assert got == plain(rows)


def test_wavelet_finds_ranks():
    rng = np.random.default_rng(2)
    for _ in range(200):
        v = rng.integers(0, rng.integers(1, 20), rng.integers(0, 60))
        before = rng.integers(0, 4, 20) if rng.random() < 0.5 else None
        s = rng.integers(0, len(v) + 1, 30)
        e = np.array([rng.integers(x, len(v) + 1) for x in s])
        keep, want = [], []
        for i in range(30):
            base = [] if before is None else np.repeat(np.arange(len(before)), before).tolist()
            full = sorted(base + v[s[i]:e[i]].tolist())
            if full:
                t = int(rng.integers(len(full)))
                keep.append((s[i], e[i], t))
                want.append((full[t], t - full.index(full[t])))
        if keep:
            a = np.array(keep)
            got = nth_smallest(v, a[:, 0], a[:, 1], a[:, 2], before)
            assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want
    v = np.array([3.0, np.nan, 1.0, 2.0, 5.0])
    assert np.array_equal(medians_before(v, np.array([0, 0, 0, 0, 4])), [np.nan, 3.0, 3.0, 2.0, np.nan], equal_nan=True)


def test_blocks_of_one_partition_and_recent_counts(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab") if i % 5 else "hot", rng.randrange(60), i, rng.choice([None, 1.0, 2.5, float(rng.randrange(9))]))
            for i in range(700)]
    df = spark.createDataFrame(rows, "g string, step long, id long, v double")
    got = {r["id"]: (r["m"], r["n"]) for r in running_median(
        df, "g", ["step", "id"], "v", "m", num_partitions=2, recent=("step", 7, "n"), chunk_rows=40).collect()}
    assert len(got) == len(rows)
    for g, step, i, _ in rows:
        before = [x[3] for x in rows if x[0] == g and (x[1], x[2]) < (step, i) and x[3] is not None]
        near = sum(x[0] == g and step - 7 <= x[1] < step for x in rows)
        assert got[i] == (statistics.median(before) if before else None, near)


def test_sorted_rows_are_written_without_what_they_hold_already(spark, ledger):
    """The group and a value that is a double are columns of the rows; conditions travel as one number."""
    import glob
    import os
    import pyarrow.parquet as pq
    from ledgerscope.operators.features import features
    from ledgerscope.session import checkpoint_dir
    rows = [{"step": i, "tx_type": [None, "DEBIT", "other", "TRANSFER"][i % 4], "sender_id": f"S{i % 3}", "receiver_id": "R", "amount": 5.0,
             "sender_balance_before": [None, 100.0, 5.0][i % 3], "sender_balance_after": [0.0, None, 0.0][i % 3]} for i in range(12)]
    top = checkpoint_dir(spark).removeprefix("file:")
    old = set(glob.glob(f"{top}/sorted-*"))
    got = {r["row_id"]: r for r in features(ledger(rows)).collect()}
    new, = set(glob.glob(f"{top}/sorted-*")) - old
    names = {c for f in glob.glob(os.path.join(new, "*.parquet")) for c in pq.ParquetFile(f).schema_arrow.names}
    assert "amount" in names and not names & {"_value", "_group", "tx_type", "_drained", "_mismatch"}
    for i, r in enumerate(rows):
        before, after = r["sender_balance_before"], r["sender_balance_after"]
        known = before is not None and after is not None
        want = (float(r["tx_type"] == "DEBIT"), float(r["tx_type"] == "TRANSFER"), 0.0, float(known and after < 0.1 * before),
                float(known and abs(before - 5.0 - after) > 0.01))
        x = got[i]
        assert (x["tx_type_DEBIT"], x["tx_type_TRANSFER"], x["tx_type_PAYMENT"], x["sender_drained"], x["balance_mismatch"]) == want


def test_written_rows_come_back_from_compressed_columns(spark):
    from pyspark.sql import functions as F
    from ledgerscope.functions.core import written
    rows = spark.range(1000).select("id", F.lit("a model").alias("model"), F.struct((F.col("id") % 3).alias("x")).alias("s"),
                                    F.when(F.col("id") > 3, F.lit(float("nan"))).alias("v"))
    back = written(rows)
    assert back.schema.simpleString() == rows.schema.simpleString()
    assert all(f.endswith(".zstd.parquet") for f in back.inputFiles())
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
