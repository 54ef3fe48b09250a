import os
import tempfile

import pytest

from ledgerscope.operators import ledger_ops as LO
from ledgerscope.operators.detectors import amount_median, balance_inconsistency
from ledgerscope.operators.timeline import timeline
from ledgerscope.schemas import LEDGER_COLUMNS
from ledgerscope.sources.ledger import ledger_head, read_ledger
from ledgerscope.streaming.ingest import ingest, read_ingested

HEADER = ("step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,"
          "newbalanceDest,isFraud,isFlaggedFraud")


def write_csv(folder, name, n=50):
    lines = [HEADER]
    for i in range(n):
        lines.append(f"{1 + i * 7 % 13},PAYMENT,{10.5 * (i + 1)},acc-{i % 6},{500 + i},{400 + i},shop-{i % 4},"
                     f"{i},{2 * i},{int(i % 9 == 4)},0")
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_csv_ingest_normalize_filters_history(spark):
    d = tempfile.mkdtemp(prefix="ls-csv-")
    path = write_csv(d, "log.csv")
    L = read_ledger(spark, path)
    assert L.columns == [*LEDGER_COLUMNS, "row_id"] and L.count() == 50
    types = dict(L.dtypes)
    assert [types[c] for c in ("step", "amount", "is_fraud", "sender_id")] == ["bigint", "double", "boolean", "string"]
    assert LO.filter_account(L, "acc-2").count() == sum(i % 6 == 2 for i in range(50))
    steps = [1 + i * 7 % 13 for i in range(50)]
    assert LO.filter_steps(L, 3, 5).count() == sum(3 <= s <= 5 for s in steps)
    h = {r["account_id"]: r for r in LO.account_history(L).collect()}
    assert h["acc-2"]["total_sent"] == sum(10.5 * (i + 1) for i in range(50) if i % 6 == 2)
    assert h["shop-1"]["received_count"] == sum(i % 4 == 1 for i in range(50)) and h["shop-1"]["sent_count"] == 0
    # head follows file order
    head = [r["amount"] for r in ledger_head(L, 3).collect()]
    assert head == [10.5, 21.0, 31.5]


def test_csv_columns_are_taken_by_name(spark):
    """Permuted columns, an extra one and a second file with another order give the same ledger."""
    d = tempfile.mkdtemp(prefix="ls-csv-")
    path = write_csv(d, "a.csv", 12)
    with open(path) as f:
        table = [line.strip().split(",") for line in f]
    order = [3, 9, 0, 2, 1, 10, 8, 7, 6, 5, 4]
    other = os.path.join(d, "b.csv")
    with open(other, "w") as f:
        for k, row in enumerate(table):
            f.write(",".join([row[i] for i in order] + ["branch" if k == 0 else f"b{k}"]) + "\n")
    cols = [c for c in LEDGER_COLUMNS]
    one = sorted(map(tuple, read_ledger(spark, path).select(*cols).collect()))
    two = read_ledger(spark, other)
    assert sorted(map(tuple, two.select(*cols).collect())) == one
    assert {r["branch"] for r in two.collect()} == {f"b{k}" for k in range(1, 13)}
    both = read_ledger(spark, [path, other])
    assert sorted(map(tuple, both.select(*cols).collect())) == sorted(one + one)


def test_bad_csv_is_an_error(spark):
    d = tempfile.mkdtemp(prefix="ls-csv-")
    p = os.path.join(d, "x.csv")
    with open(p, "w") as f:
        f.write(HEADER + "\n1,PAYMENT,12x,a,1,1,b,0,0,0,0\n")
    with pytest.raises(Exception, match="malformed value in column amount"):
        read_ledger(spark, p).collect()
    assert read_ledger(spark, p, on_bad="null").first()["amount"] is None
    with open(p, "w") as f:
        f.write("step,type\n1,PAYMENT\n")
    with pytest.raises(ValueError, match="required columns"):
        read_ledger(spark, p)


def test_self_transfer_counts_twice(ledger):
    L = ledger([dict(step=1, sender_id="A", receiver_id="A", amount=5.0)])
    h = LO.account_history(L).collect()[0]
    assert (h["tx_count"], h["total_sent"], h["total_received"]) == (2, 5.0, 5.0)
    assert LO.participations(L).count() == 2


def test_nan_and_null_party(spark):
    """Rows without a party stay: they count in the dataset-level rules and nowhere else."""
    d = tempfile.mkdtemp(prefix="ls-csv-")
    p = os.path.join(d, "x.csv")
    with open(p, "w") as f:
        f.write(HEADER + "\n1,TRANSFER,NaN,A,NaN,1,B,0,0,0,0\n2,TRANSFER,5,,1,1,B,0,0,0,0\n"
                "3,TRANSFER,7,A,9,1,,0,0,0,0\n")
    L = read_ledger(spark, p)
    rows = {r["step"]: r for r in L.collect()}
    assert len(rows) == 3 and rows[1]["amount"] is None and rows[1]["sender_balance_before"] is None
    assert rows[2]["sender_id"] is None and rows[3]["receiver_id"] is None
    assert balance_inconsistency(L).first()["description"].startswith("2 of 3 transactions")
    assert amount_median(L).first()["median"] == 6.0
    assert {r["account_id"] for r in LO.account_history(L).collect()} == {"A", "B"}
    events = timeline(L).collect()
    assert sorted((r["account_id"], r["step"]) for r in events) == [("A", 1), ("A", 3), ("B", 1), ("B", 2)]


def test_streaming_ingest_once(spark):
    src = tempfile.mkdtemp(prefix="ls-src-")
    dst = tempfile.mkdtemp(prefix="ls-dst-") + "/ledger"
    write_csv(src, "a.csv", 20)
    write_csv(src, "b.csv", 30)
    q = ingest(spark, src, dst)
    q.awaitTermination(120)
    got = read_ingested(spark, dst)
    assert got.count() == 50
    assert set(got.columns) >= {"step", "sender_id", "row_id", "is_fraud"}


def test_streaming_ingest_restart_is_exactly_once(spark):
    src = tempfile.mkdtemp(prefix="ls-src-")
    dst = tempfile.mkdtemp(prefix="ls-dst-") + "/ledger"
    ckpt = tempfile.mkdtemp(prefix="ls-ck-") + "/c"
    write_csv(src, "a.csv", 20)
    ingest(spark, src, dst, checkpoint=ckpt).awaitTermination(120)
    ingest(spark, src, dst, checkpoint=ckpt).awaitTermination(120)  # nothing new
    assert read_ingested(spark, dst).count() == 20
    write_csv(src, "b.csv", 30)
    ingest(spark, src, dst, checkpoint=ckpt).awaitTermination(120)
    assert read_ingested(spark, dst).count() == 50


def test_parquet_raw_log(spark):
    d = tempfile.mkdtemp(prefix="ls-csv-")
    path = write_csv(d, "log.csv")
    from ledgerscope.sources.ledger import read_raw
    pq = tempfile.mkdtemp(prefix="ls-pq-") + "/raw"
    read_raw(spark, path).drop("row_id").write.parquet(pq)
    a = sorted(map(tuple, read_ledger(spark, path).drop("row_id").collect()))
    b = sorted(map(tuple, read_ledger(spark, pq, fmt="parquet").drop("row_id").collect()))
    assert a == b and len(a) == 50
    head = [r["amount"] for r in ledger_head(read_ledger(spark, pq, fmt="parquet"), 2).collect()]
    assert head == [10.5, 21.0]
