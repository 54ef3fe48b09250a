import datetime
import hashlib
import hmac
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions.core import canonical_json, hmac_sha256
from ledgerscope.operators import custody as K
from ledgerscope.operators import findings as FD
from ledgerscope.operators import report as R
from ledgerscope.sources.store import CaseStore


def write(folder, name, data: bytes):
    p = os.path.join(folder, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_file_digests_and_verify(spark):
    d = tempfile.mkdtemp(prefix="ls-ev-")
    a = write(d, "a.txt", b"test data")
    b = write(d, "b.bin", os.urandom(9 * 1024 * 1024 + 17))  # spans several chunks
    paths = spark.createDataFrame([(a,), (b,), (d + "/missing",)], "path string")
    got = {r["path"]: r for r in K.digest_files(paths).collect()}
    for p in (a, b):
        raw = open(p, "rb").read()
        assert got[p]["sha256"] == hashlib.sha256(raw).hexdigest()
        assert got[p]["md5"] == hashlib.md5(raw).hexdigest()
        assert got[p]["file_size"] == len(raw) and got[p]["exists"]
    assert len(got[a]["sha256"]) == 64
    assert not got[d + "/missing"]["exists"]
    exp = spark.createDataFrame([(a, hashlib.sha256(b"test data").hexdigest()),
                                 (d + "/missing", "00")], "path string, sha256 string")
    v = {r["path"]: r["verified"] for r in K.verify_files(exp).collect()}
    assert v == {a: True, d + "/missing": False}


def test_hmac_matches_python_and_tamper(spark):
    msgs = ["", "abc", '{"a": 1}', "x" * 200, "ümlaut"]
    for key in ["k", "a longer secret key", "K" * 100]:
        df = spark.createDataFrame([(m,) for m in msgs], "m string")
        got = [r[0] for r in df.select(hmac_sha256(F.col("m"), key)).collect()]
        want = [hmac.new(key.encode(), m.encode(), hashlib.sha256).hexdigest() for m in msgs]
        assert got == want
    rec = spark.createDataFrame([("c1", "h", 1)], "case_id string, custody_hash string, n int")
    s = K.sign_records(rec, "key").collect()[0]["signature"]
    tampered = spark.createDataFrame([("c1", "h", 2, s)],
                                     "case_id string, custody_hash string, n int, signature string")
    ok = K.verify_signatures(tampered, "key", ["case_id", "custody_hash", "n"]).collect()[0]
    assert s != "" and not ok["signature_valid"]


def test_table_digest_order_sensitive_column_insensitive(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "k long, v string")
    d1 = K.digest_table(df, ["k"], fanout=4).collect()[0]
    d2 = K.digest_table(df.select("v", "k"), ["k"], fanout=4).collect()[0]
    d3 = K.digest_table(df.withColumn("k", 49 - F.col("k")), ["k"], fanout=4).collect()[0]
    assert d1["sha256"] == d2["sha256"] and d1["sha256"] != d3["sha256"]
    assert d1["n_rows"] == 50 and len(d1["sha256"]) == 64


def test_manifest_roundtrip_and_tamper(spark):
    d = tempfile.mkdtemp(prefix="ls-man-")
    a = write(d, "a.txt", b"first")
    b = write(d, "b.txt", b"second")
    files = K.digest_files(spark.createDataFrame([(a, 1, "c1"), (b, 2, "c1")],
                                                 "path string, seq int, case_id string"))
    table = spark.createDataFrame([("c1", 3, "tbl", hashlib.sha256(b"t").hexdigest())],
                                  "case_id string, seq int, label string, sha256 string")
    items = K.manifest_items(files, table)
    cases = spark.createDataFrame([("c1", "inv")], "id string, investigator string")
    man = K.finalize(items, cases)
    h = man.collect()[0]["manifest_hash"]
    expect = hashlib.sha256((hashlib.sha256(b"first").hexdigest()
                             + hashlib.sha256(b"second").hexdigest()
                             + hashlib.sha256(b"t").hexdigest()).encode()).hexdigest()
    assert h == expect
    out = tempfile.mkdtemp(prefix="ls-manjson-") + "/m"
    K.write_manifests(man, out)
    ok = K.verify_manifest(K.read_manifests(spark, out)).collect()[0]
    assert ok["valid"] and ok["failed_items"] == []
    write(d, "a.txt", b"tampered")
    bad = K.verify_manifest(K.read_manifests(spark, out)).collect()[0]
    assert not bad["valid"] and bad["failed_items"] == ["a.txt"]
    forged = K.read_manifests(spark, out).withColumn("manifest_hash", F.lit("0" * 64))
    bad2 = K.verify_manifest(forged).collect()[0]
    assert bad2["failed_items"][0] == "manifest_hash"
    custody = R.report_custody(man).orderBy("seq").collect()
    assert custody[3]["value"] == "List of items:" and custody[4]["key"] == "  Item 1 - type"
    # an item has rows for its own keys only: eight of a file, four of a table
    assert len(custody) == 3 + 1 + 2 * 8 + 4 + 1
    assert {r["key"] for r in custody if r["key"].startswith("  Item 3")} == {
        f"  Item 3 - {k}" for k in ("type", "sha256", "acquired_at", "label")}
    empty = K.finalize(items.where("seq > 99"), cases).collect()[0]["manifest_hash"]
    assert empty == hashlib.sha256(b"").hexdigest()


def test_case_store_summary_and_errors(spark):
    root = tempfile.mkdtemp(prefix="ls-store-")
    store = CaseStore(spark, root)
    case = store.register_cases(spark.createDataFrame(
        [("Case A", "desc", "inv")], "name string, description string, investigator string")
    ).collect()[0]
    assert case["status"] == "open" and len(case["id"]) == 36
    cid = case["id"]
    ev = write(tempfile.mkdtemp(), "e.csv", b"test data")
    row = store.register_evidence(spark.createDataFrame(
        [(cid, ev, "n")], "case_id string, path string, notes string")).collect()[0]
    assert row["sha256_hash"] == hashlib.sha256(b"test data").hexdigest()
    assert row["file_size"] == 9
    f = spark.createDataFrame(
        [(cid, "rapid_drain", s, "d", ["A", "B"], 1, 2, c, None) for s, c in
         (("high", 0.9), ("high", 0.95), ("medium", 0.8))],
        "case_id string, finding_type string, severity string, description string, "
        "account_ids array<string>, step_start long, step_end long, confidence double, "
        "amount double")
    assert store.save_findings(f) == 3
    s = FD.case_summary(store.cases(), store.evidence(), store.findings()).collect()[0]
    assert (s["evidence_count"], s["findings_count"], s["high"], s["medium"], s["low"]) == \
        (1, 3, 2, 1, 0)
    assert store.save_findings(f, mode="replace") == 3
    assert store.findings(cid).count() == 3  # replace, not append
    store.save_findings(f)
    assert store.findings(cid).count() == 6  # append duplicates like the reference
    stored = store.findings(cid).collect()[0]
    assert stored["account_ids"] == ["A", "B"]
    assert [r["path"] for r in store.ledger_paths(cid).collect()] == [ev]
    bad = f.withColumn("case_id", F.lit("nope"))
    with pytest.raises(ValueError):
        store.save_findings(bad)
    with pytest.raises(ValueError):
        store.register_evidence(spark.createDataFrame([("nope", ev)], "case_id string, path string"))
    with pytest.raises(FileNotFoundError):
        store.register_evidence(spark.createDataFrame([(cid, ev + ".x")],
                                                      "case_id string, path string"))
    store.delete_findings(cid)
    assert store.findings(cid).count() == 0


FOUND = ("case_id string, finding_type string, severity string, description string, account_ids array<string>, "
         "step_start long, step_end long, confidence double, amount double")


def test_store_resets_and_case_ids(spark):
    store = CaseStore(spark, tempfile.mkdtemp(prefix="ls-store-"))
    ids = ["c:2/x", "c1"]
    cases = spark.createDataFrame([(i, i, "inv") for i in ids], "id string, name string, investigator string")
    store.register_cases(cases)
    with pytest.raises(ValueError, match="in use"):
        store.register_cases(cases.limit(1))
    f = spark.createDataFrame([(i, "fan_out", "low", "d", ["A"], 1, 2, 0.7, None) for i in ids], FOUND)
    store.save_findings(f)
    store.delete_findings("c:2/x")
    assert [r["case_id"] for r in store.findings().collect()] == ["c1"]
    store.save_findings(f)                                  # after a reset findings count again
    assert store.findings().count() == 3
    assert store.save_findings(f.limit(0), "replace", cases.select(F.col("id").alias("case_id"))) == 0
    assert store.findings().count() == 0


def test_relative_evidence_becomes_absolute(spark, monkeypatch):
    d = tempfile.mkdtemp(prefix="ls-rel-")
    write(d, "e.csv", b"x")
    store = CaseStore(spark, tempfile.mkdtemp(prefix="ls-store-"))
    store.register_cases(spark.createDataFrame([("c", "n", "i")], "id string, name string, investigator string"))
    monkeypatch.chdir(d)
    store.register_evidence(spark.createDataFrame([("c", "e.csv")], "case_id string, path string"))
    assert store.evidence().first()["filename"] == os.path.join(os.path.realpath(d), "e.csv")


def test_empty_manifest_is_valid_and_item_order_counts(spark):
    cases = spark.createDataFrame([("c", "i"), ("e", "i")], "id string, investigator string")
    tables = spark.createDataFrame([("c", 1, "a", "1" * 64), ("c", 2, "b", "2" * 64)],
                                   "case_id string, seq int, label string, sha256 string")
    path = tempfile.mkdtemp(prefix="ls-m-") + "/m"
    K.write_manifests(K.finalize(K.manifest_items(tables=tables), cases), path)
    back = K.read_manifests(spark, path)
    assert {r["case_id"]: r["valid"] for r in K.verify_manifest(back).collect()} == {"c": True, "e": True}
    turned = back.withColumn("items", F.reverse("items"))
    assert {r["case_id"]: r["valid"] for r in K.verify_manifest(turned).collect()} == {"c": False, "e": True}


def test_signatures_do_not_depend_on_the_time_zone(spark):
    row = spark.sql("SELECT timestamp_micros(1700000000000000) AS t, CAST(NULL AS STRING) AS x")
    texts = set()
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        texts.add(row.select(canonical_json(row)).first()[0])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(texts) == 1 and '"x":null' in texts.pop()


def test_cases_that_share_an_account_stay_apart(spark):
    cols = "case_id string, step long, tx_type string, amount double, sender_id string, receiver_id string, row_id long"
    led = spark.createDataFrame([("c1", 1, "TRANSFER", 5.0, "A", "B", 1), ("c2", 2, "TRANSFER", 7.0, "A", "B", 2)], cols)
    for c in ("sender_balance_before", "sender_balance_after", "receiver_balance_before", "receiver_balance_after"):
        led = led.withColumn(c, F.lit(None).cast("double"))
    f = spark.createDataFrame([("c1", "rapid_drain", "high", "d", ["A"], 1, 9, 0.9, 1.0),
                               ("c2", "fan_out", "low", "d", ["A"], 1, 9, 0.7, 1.0),
                               ("c3", "balance_inconsistency", "high", "d", ["DATASET"], 1, 9, 1.0, 1.0)], FOUND)
    got = {(r["case_id"], r["step"], r["annotation"]) for r in R.report_timelines(led, f).collect()}
    assert got == {("c1", 1, "[RAPID DRAIN]"), ("c2", 2, "")}
    cases = spark.createDataFrame([("c1",), ("c2",), ("c3",), ("c4",)], "id string")
    text = {r["case_id"]: r["narrative"] for r in R.report_summary(led, f, cases).collect()}
    assert "rapid drain" in text["c1"] and "fan out" in text["c2"] and "7.00" in text["c2"]
    assert text["c3"] == R.NO_ACCOUNT and text["c4"] == R.NO_FINDINGS


def test_report_findings_and_accounts(spark):
    rows = [("c", "rapid_drain", "high", "d", [f"A{i}"], i, i + 1, 0.9, float(i)) for i in range(120)]
    rows.append(("c", "balance_inconsistency", "high", "x", ["DATASET"], 0, 9, 1.0, 5.0))
    f = spark.createDataFrame(rows, "case_id string, finding_type string, severity string, "
                              "description string, account_ids array<string>, step_start long, "
                              "step_end long, confidence double, amount double")
    t = R.report_findings(f).orderBy("rank").collect()
    assert len(t) == 100 and t[0]["account_id"] == "DATASET" and t[0]["confidence"] == "100%"
    assert t[1]["account_id"] == "A119" and t[1]["severity"] == "High"
    assert t[0]["title"] == "5. FINDINGS TABLE (Top 100 of 121 total)"
    top = [r["account_id"] for r in FD.top_accounts(f, 5).orderBy("rank").collect()]
    assert top == ["A119", "A118", "A117", "A116", "A115"]
    br = {r["finding_type"]: r for r in FD.findings_breakdown(f).collect()}
    assert br["rapid_drain"]["count"] == 120 and br["TOTAL"]["count"] == 121
    assert br["TOTAL"]["ord"] == 3


def test_merge_intervals_pieces_are_disjoint_and_cover(spark):
    big = 9223372036854775807
    rows = [("A", 1, 5), ("A", 3, 8), ("A", 10, 10), ("A", 11, 12), ("A", 20, big),
            ("A", 25, 30), ("B", 4, 4), ("B", 4, 4)]
    iv = spark.createDataFrame(rows, "account_id string, step_start long, step_end long")
    pieces = sorted((r[0], r[1], r[2]) for r in FD.merge_intervals(iv, ["account_id"]).collect())
    for acc in ("A", "B"):
        ps = [(s, e) for a, s, e in pieces if a == acc]
        assert all(ps[i][1] < ps[i + 1][0] for i in range(len(ps) - 1))  # disjoint
        for step in list(range(0, 40)) + [big - 1]:
            covered = any(a == acc and s <= step <= e for a, s, e in rows)
            assert covered == any(s <= step <= e for s, e in ps), (acc, step)


def test_interval_join_matches_brute_force(spark):
    import random
    rng = random.Random(4)
    big = 9223372036854775807
    iv = [("H", s, s + rng.randrange(0, 6)) for s in range(0, 300, 7)] + [("H", 400, big),
                                                                         ("K", 5, 9)]
    pts = [(i, "H" if i % 4 else "K", rng.randrange(0, 500)) for i in range(400)]
    pts.append((999, "H", None))
    pieces = FD.merge_intervals(spark.createDataFrame(
        iv, "account_id string, step_start long, step_end long"), ["account_id"])
    P = spark.createDataFrame(pts, "id long, account_id string, step long")
    got = {r["id"]: r["step_start"] is not None
           for r in FD.interval_join(P, pieces, ["account_id"], how="left").collect()}
    assert len(got) == len(pts)  # left join, no duplication
    for i, a, st in pts:
        want = st is not None and any(k == a and s <= st <= e for k, s, e in iv)
        assert got[i] == want, (i, a, st)


def test_report_tables_written(spark, ledger):
    from ledgerscope.operators.analyze import analyze, to_payload
    rows = [dict(step=i % 9, sender_id=f"A{i % 5}", receiver_id=f"B{i % 7}", amount=10.0 + i,
                 sender_balance_before=100.0, sender_balance_after=1.0) for i in range(60)]
    L = ledger(rows)
    findings = to_payload(analyze(L), "c1")
    d = tempfile.mkdtemp(prefix="ls-rep-")
    a = write(d, "a.txt", b"x")
    items = K.manifest_items(K.digest_files(spark.createDataFrame(
        [(a, 1, "c1")], "path string, seq int, case_id string")))
    cases = spark.createDataFrame([("c1", "n", "inv", "open")],
                                  "id string, name string, investigator string, status string")
    man = K.finalize(items, cases)
    tables = R.report_tables(L, findings, cases, man, items, key="k")
    out = tempfile.mkdtemp(prefix="ls-repout-") + "/r"
    R.write_report(tables, out)
    assert sorted(os.listdir(out)) == sorted(["cover", "summary", "evidence", "findings",
                                              "timelines", "custody", "signature"])
    summary = spark.read.parquet(out + "/summary").collect()[0]["narrative"]
    assert summary.startswith("The forensic analysis of account ")
    sig = spark.read.parquet(out + "/signature").collect()[0]
    want = hmac.new(b"k", ('{"case_id":"c1","custody_hash":"%s","generated_at":"%s"}'
                           % (sig["custody_hash"], sig["generated_at"])).encode(),
                    hashlib.sha256).hexdigest()
    assert sig["signature"] == want


def test_manifest_of_a_large_case_is_rows(spark, monkeypatch):
    """No row grows with a case: hash, written lines and report rows of a case with many items, an
    empty case and a case without an id."""
    n = 1000
    rows = [("big", n - i, f"f{i}", hashlib.sha256(b"%d" % i).hexdigest()) for i in range(n)]
    rows += [("big", 7, "same", "0" * 64), ("small", 1, "x", "a" * 64), (None, 2, "y", "b" * 64),
             (None, 1, "z", None), ("unlisted", 1, "u", "c" * 64)]
    items = spark.createDataFrame(rows, "case_id string, seq long, filename string, sha256 string").repartition(5)
    have = items.columns
    for f in K.ITEM_SCHEMA.fields:
        if f.name not in have:
            items = items.withColumn(f.name, F.lit("file" if f.name == "type" else None).cast(f.dataType))
    cases = spark.createDataFrame([(c, "i") for c in ("big", "small", "empty", None)], "id string, investigator string")
    want = {}
    for c in ("big", "small", None):
        own = sorted(((s, d or "") for k, s, _, d in rows if k == c))
        want[c] = (hashlib.sha256("".join(d for _, d in own).encode()).hexdigest(), len(own))
    got = {r["case_id"]: (r["manifest_hash"], r["n_items"]) for r in K.manifest_hash(items).collect()}
    assert {k: v for k, v in got.items() if k != "unlisted"} == want
    assert "collect_list" not in K.manifest_hash(items)._jdf.queryExecution().toString()

    head, flat = K.finalize_rows(items, cases)
    path = tempfile.mkdtemp(prefix="ls-rows-") + "/m"
    K.write_manifest_rows(head, flat, path)
    lines = spark.read.text([f"{path}/manifests", f"{path}/items"])
    assert lines.agg(F.max(F.length("value"))).first()[0] < 500
    back, again = K.read_manifest_rows(spark, path)
    want["empty"] = (hashlib.sha256(b"").hexdigest(), 0)
    assert {r["case_id"]: (r["manifest_hash"], r["n_items"]) for r in back.collect()} == want
    assert {r["case_id"]: r["manifest_hash"] for r in K.manifest_hash(again, "pos").collect()} == {
        c: h for c, (h, _) in want.items() if c != "empty"}

    plain = items.where("filename <> 'same'")                # the nested form breaks ties by other columns
    got = sorted(((r["case_id"], r["seq"], r["key"], r["value"]) for r in R.report_custody_rows(*K.finalize_rows(plain, cases))
                  .where("case_id is not null and key <> 'finalized_at'").collect()))
    nested = sorted(((r["case_id"], r["seq"], r["key"], r["value"]) for r in R.report_custody(K.finalize(plain, cases))
                     .where("case_id is not null and key <> 'finalized_at'").collect()))
    assert got == nested
    nobody = R.report_custody_rows(head, flat).where("case_id is null").orderBy("seq").collect()
    assert [r["seq"] for r in nobody] == list(range(len(nobody))) and nobody[-1]["value"] == want[None][0]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver test data absent")
@pytest.mark.parametrize("name", ["manifest_hash_documents", "manifest_roundtrip_documents", "report_custody_documents"])
def test_document_manifests_collect_no_case(spark, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, "/root/testdata/sf0.001")
    assert "collect_list" not in df._jdf.queryExecution().toString() and df.count() > 0


def test_stored_digest_tree_finds_the_changed_rows(spark):
    from ledgerscope.operators import digest_tree as DT
    df = spark.range(5000).select("id", F.concat(F.lit("v"), F.col("id") % 17).alias("v"))
    path = tempfile.mkdtemp(prefix="ls-tree-") + "/t"
    DT.write_digest_tree(df, ["id"], path, rows_per_leaf=20)
    nodes, rows = DT.read_digest_tree(spark, path)
    assert rows.count() == 5000 and nodes.where("level = 0").first()["n_rows"] == 5000
    depth = nodes.agg(F.max("level")).first()[0]
    assert depth == 2 and nodes.where(F.col("level") == depth).agg(F.max("n_rows")).first()[0] < 60
    assert DT.verify_table(df.repartition(7), ["id"], path).count() == 0
    one = df.withColumn("v", F.when(F.col("id") == 77, "other").otherwise(F.col("v")))
    assert [tuple(r) for r in DT.verify_table(one, ["id"], path).collect()] == [(77, "changed")]
    new = DT.tree_nodes(DT.tree_rows(one, ["id"], None, depth), depth)
    assert DT.differing_leaves(nodes, new, depth).count() == 1
    assert new.join(nodes, ["level", "node", "sha256"], "left_anti").count() == depth + 1    # one path
    more = one.where("id <> 4999").unionByName(spark.createDataFrame([(9000, None)], "id long, v string"))
    assert sorted(tuple(r) for r in DT.verify_table(more, ["id"], path).collect()) == [(77, "changed"), (4999, "removed"), (9000, "added")]
    other = path + "2"
    DT.write_digest_tree(df.orderBy(F.desc("id")), ["id"], other, rows_per_leaf=20)
    assert DT.tree_root(spark, other) == DT.tree_root(spark, path)
    DT.write_digest_tree(df.limit(0), ["id"], other)
    assert DT.verify_table(df.limit(0), ["id"], other).count() == 0
    assert [tuple(r) for r in DT.verify_table(df.where("id = 3"), ["id"], other).collect()] == [(3, "added")]


def test_table_items_are_verified_when_their_table_is_given(spark):
    table = spark.createDataFrame([(i, i * 0.5) for i in range(30)], "k long, v double")
    items = K.manifest_items(tables=K.digest_table(table, ["k"], label="ledger").select(
        F.lit("c").alias("case_id"), F.lit(1).alias("seq"), "label", "sha256"))
    cases = spark.createDataFrame([("c", "i")], "id string, investigator string")
    path = tempfile.mkdtemp(prefix="ls-m-") + "/m"
    K.write_manifests(K.finalize(items, cases), path)
    back = K.read_manifests(spark, path)
    changed = table.withColumn("v", F.when(F.col("k") == 4, 0.0).otherwise(F.col("v")))
    assert K.verify_manifest(back).first()["valid"]
    assert K.verify_manifest(back, {"ledger": (table, ["k"])}).first()["valid"]
    assert K.verify_manifest(back, {"ledger": (changed, ["k"])}).first()["failed_items"] == ["ledger"]
    head, rows = K.finalize_rows(items, cases)
    assert K.verify_manifest_rows(head, rows, tables={"ledger": (table, ["k"])}).count() == 0
    assert [tuple(r) for r in K.verify_manifest_rows(head, rows, tables={"ledger": (changed, ["k"])}).collect()] == [("c", "ledger")]


def test_row_form_manifests_are_verified(spark):
    d = tempfile.mkdtemp(prefix="ls-rows-")
    names = [write(d, f"{i}.txt", b"x" * i) for i in range(5)]
    files = K.digest_files(spark.createDataFrame([(n, i, "c" if i < 3 else "e") for i, n in enumerate(names)], "path string, seq int, case_id string"))
    cases = spark.createDataFrame([("c", "i"), ("e", "i"), ("none", "i")], "id string, investigator string")
    path = tempfile.mkdtemp(prefix="ls-m-") + "/m"
    K.write_manifest_rows(*K.finalize_rows(K.manifest_items(files), cases), path)
    head, rows = K.read_manifest_rows(spark, path)
    assert K.verify_manifest_rows(head, rows).count() == 0
    write(d, "1.txt", b"other")
    os.remove(names[4])
    assert sorted(tuple(r) for r in K.verify_manifest_rows(head, rows).collect()) == [("c", "1.txt"), ("e", "4.txt")]
    short = rows.where("pos < 2 OR case_id = 'e'")
    assert ("c", "manifest_hash") in {tuple(r) for r in K.verify_manifest_rows(head, short).collect()}


def test_files_are_dealt_by_size(spark):
    import random
    rng = random.Random(4)
    sizes = [rng.choice([1_000, 5_000, 2_000_000]) + rng.randrange(900) for _ in range(300)] + [90_000_000, 0]
    df = spark.createDataFrame([(f"f{i}", s) for i, s in enumerate(sizes)], "path string, size long")
    for tasks in (1, 4, 16):
        dealt = K.by_size(df, tasks).withColumn("p", F.spark_partition_id()).collect()
        held = {}
        for r in dealt:
            held[r["p"]] = held.get(r["p"], 0) + r["size"]
        total = sum(held.values())
        assert len(dealt) == len(sizes) and max(held.values()) <= max(r["size"] for r in dealt) + total / tasks


def _files(path):
    return sum(n.endswith(".parquet") for _, _, names in os.walk(path) for n in names)


def test_compaction_keeps_findings_and_pinned_readers(spark):
    root = tempfile.mkdtemp(prefix="ls-store-")
    store = CaseStore(spark, root)
    ids = ["c1", "c2", "c3"]
    store.register_cases(spark.createDataFrame([(i, i, "inv") for i in ids], "id string, name string, investigator string"))
    f = spark.createDataFrame([(i, "fan_out", "low", f"d{k}", ["A"], k, 2, 0.7, None) for i in ids for k in range(4)], FOUND).repartition(4)
    for _ in range(3):
        store.save_findings(f)
    store.save_findings(f.where("case_id = 'c2'"), "replace")
    store.delete_findings("c3")
    cols = ["id", "case_id", "description", "created_at"]
    before = sorted(map(tuple, store.findings().select(cols).collect()), key=str)
    reader = store.findings().select(cols)                  # started before the compaction
    files = _files(root + "/findings")
    assert store.generation() == 0 and store.compact() == 1 and store.generation() == 1
    assert len(before) == 12 + 4 and sorted(map(tuple, store.findings().select(cols).collect()), key=str) == before
    assert _files(root + "/findings-1") < files
    assert sorted(map(tuple, reader.collect()), key=str) == before
    store.save_findings(f.where("case_id = 'c3'"))           # into the new generation
    assert store.findings("c3").count() == 4 and sorted(map(tuple, reader.collect()), key=str) == before
    # a compaction that stops before its commit isn't read, and is written over by the next one
    f.limit(1).write.parquet(root + "/findings-2")
    assert store.findings().count() == 20 and store.compact() == 2 and store.findings().count() == 20
    store.delete_findings("c1")
    assert store.findings().count() == 8 and store.findings(generation=1).count() == 20
    assert sorted(os.path.basename(p) for p in store.vacuum()) == ["findings", "resets"]
    assert store.findings().count() == 8 and not os.path.exists(root + "/findings")


def test_csv_rows_have_compact_numbers_in_file_order(spark):
    from ledgerscope.sources import ledger as SL
    d = tempfile.mkdtemp(prefix="ls-num-")
    head = "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud\n"
    for name, n in (("b b.csv", 400), ("a+1.csv", 300), ("c.csv", 1)):
        with open(f"{d}/{name}", "w") as f:
            f.write(head + "".join(f"{i},PAYMENT,{i}.5,{name[0]}{i},1,0,X,0,1,0,0\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        led = SL.read_ledger(spark, d)
        assert dict(led.select("row_id.*").dtypes) == {"file": "int", "at": "bigint"}
        rows = [(r["sender_id"], r["row_id"]) for r in led.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len({r for _, r in rows}) == len(rows) == 701
    assert [s for s, _ in sorted(rows, key=lambda x: x[1])] == [f"{x}{i}" for x, n in (("a", 300), ("b", 400), ("c", 1)) for i in range(n)]
    cases = spark.createDataFrame([("k", f"{d}/a+1.csv"), ("k", f"file:{d}/c.csv"), ("m", f"{d}/b b.csv"), ("m", f"{d}/c.csv")], "case_id string, path string")
    got = {r["case_id"]: r["count"] for r in SL.case_ledger(spark, cases).groupBy("case_id").count().collect()}
    assert got == {"k": 301, "m": 401}


def test_folder_is_one_evidence_item(spark, tmp_path):
    """A table of many part files is one item, whose digest follows its files' names and bytes."""
    import hashlib
    root = str(tmp_path / "t.parquet")
    os.makedirs(root + "/sub")
    parts = {"part-1": b"bb", "part-0": b"a", "sub/part-2": b""}
    for n, data in parts.items():
        write(root, n, data)
    plain = write(str(tmp_path), "plain.bin", b"xyz")
    empty = str(tmp_path / "empty")
    os.makedirs(empty)
    paths = spark.createDataFrame([(root,), (plain,), (empty,), (str(tmp_path / "no"),)], "path string")
    got = {r["path"]: r for r in K.digest_files(paths).collect()}
    lines = "".join(f"{n} {hashlib.sha256(parts[n]).hexdigest()}\n" for n in sorted(parts))
    assert got[root]["exists"] and got[root]["file_size"] == 3 and got[root]["error"] is None
    assert got[root]["sha256"] == hashlib.sha256(lines.encode()).hexdigest()
    assert got[plain]["sha256"] == hashlib.sha256(b"xyz").hexdigest() and got[plain]["file_size"] == 3
    assert got[empty]["exists"] and got[empty]["sha256"] == hashlib.sha256(b"").hexdigest()
    assert not got[str(tmp_path / "no")]["exists"] and got[str(tmp_path / "no")]["sha256"] is None
    store = CaseStore(spark, str(tmp_path / "store"))
    store.register_cases(spark.createDataFrame([("c", "n", "i")], "id string, name string, investigator string"))
    store.register_evidence(spark.createDataFrame([("c", root)], "case_id string, path string"))
    assert [r["file_size"] for r in store.evidence().collect()] == [3]
    before = got[root]["sha256"]
    os.rename(f"{root}/part-1", f"{root}/part-3")
    assert K.digest_files(paths).where(F.col("path") == root).first()["sha256"] != before


def test_detection_rate_query_joins_the_tables_once(spark, tmp_path):
    from ledgerscope.plans.catalog import QUERIES
    line = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_extendedprice double, "
            "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    day = datetime.datetime(1995, 1, 5)
    rows = [(1, 20, 1, 1, 1.0, 10.0, 0.05, "R", "F", day),       # fraud: drains S1
            (2, 40, 2, 1, 1.0, 10.0, 0.0, "R", "F", day),        # fraud: keeps its balance
            (3, 21, 3, 1, 1.0, 10.0, 0.05, "R", "F", day)]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, i) for i in (1, 2, 3)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["detection_rate"](spark, str(tmp_path))
    # the fraud rows are those of the ledger that the detectors read: it is made once
    assert not [f for f in got.inputFiles() if "lineitem" in f or "orders" in f]
    assert [tuple(r) for r in got.collect()] == [(2, 1, 0.5)]
