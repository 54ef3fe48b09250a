import random

import pytest
from pyspark.sql import functions as F

import naive
from ledgerscope.operators import detectors as D
from ledgerscope.operators.analyze import analyze, to_payload, with_severity


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ---- the reference's minimal fixtures: exactly one finding each
def test_rapid_drain_fixture(ledger):
    L = ledger([
        dict(step=1, sender_id="A", receiver_id="B", amount=200.0, sender_balance_before=1000.0,
             sender_balance_after=800.0),
        dict(step=2, sender_id="A", receiver_id="C", amount=300.0, sender_balance_before=800.0,
             sender_balance_after=500.0),
        dict(step=3, sender_id="A", receiver_id="D", amount=400.0, sender_balance_before=500.0,
             sender_balance_after=100.0),
        dict(step=4, sender_id="A", receiver_id="E", amount=50.0, sender_balance_before=100.0,
             sender_balance_after=50.0),
    ])
    out = rows_of(D.rapid_drain(L))
    assert len(out) == 1
    f = out[0]
    assert (f["account_id"], f["confidence"], f["step_start"], f["step_end"], f["amount"]) == \
        ("A", 0.9, 1, 4, 950.0)


def test_round_trip_fixture(ledger):
    L = ledger([dict(step=1, sender_id="A", receiver_id="B", amount=1000.0),
                dict(step=5, sender_id="B", receiver_id="A", amount=980.0)])
    out = rows_of(D.round_trip(L))
    assert [(r["account_id"], r["confidence"]) for r in out] == [("A", 0.85)]
    assert out[0]["description"] == "Round trip: A -> B -> A"


def test_fan_out_and_in_fixtures(ledger):
    out_l = ledger([dict(step=i, sender_id="A", receiver_id=r, amount=10.0)
                    for i, r in enumerate("BCDEFG", start=1)])
    fo = rows_of(D.fan_out(out_l))
    assert [(r["account_id"], r["confidence"], r["description"]) for r in fo] == \
        [("A", 0.75, "Fan out to 6 receivers")]
    in_l = ledger([dict(step=i, sender_id=s, receiver_id="A", amount=10.0)
                   for i, s in enumerate("BCDEFG", start=1)])
    fi = rows_of(D.fan_in(in_l))
    assert [(r["account_id"], r["confidence"], r["description"]) for r in fi] == \
        [("A", 0.7, "Fan in from 6 senders")]
    assert (fi[0]["step_start"], fi[0]["step_end"], fi[0]["amount"]) == (1, 6, 60.0)


def test_dormant_fixture(ledger):
    L = ledger([dict(step=1, sender_id="A", receiver_id="B", amount=10.0),
                dict(step=2, sender_id="A", receiver_id="C", amount=20.0),
                dict(step=3, sender_id="B", receiver_id="A", amount=100.0),
                dict(step=4, sender_id="C", receiver_id="D", amount=100.0),
                dict(step=5, sender_id="D", receiver_id="A", amount=300.0)])
    out = rows_of(D.dormant_activation(L))
    assert [(r["account_id"], r["confidence"], r["step_start"]) for r in out] == [("D", 0.8, 5)]


def test_balance_fixture_and_analyze(ledger):
    L = ledger([dict(step=1, sender_id="A", receiver_id="B", amount=100.0,
                     sender_balance_before=1000.0, sender_balance_after=800.0)])
    out = rows_of(D.balance_inconsistency(L))
    assert len(out) == 1 and out[0]["account_id"] == "DATASET" and out[0]["confidence"] == 1.0
    assert out[0]["description"].startswith("1 of 1 transactions (100.0%)")
    all_ = rows_of(analyze(L))
    assert [r["pattern"] for r in all_] == ["balance_inconsistency"]


def test_balance_none_when_reconciled(ledger):
    L = ledger([dict(step=1, amount=100.0, sender_balance_before=1000.0,
                     sender_balance_after=900.0)])
    assert D.balance_inconsistency(L).count() == 0


# ---- edge fixtures
def test_same_step_opposite_rows_fire_twice_and_self_transfer(ledger):
    L = ledger([dict(step=3, sender_id="A", receiver_id="B", amount=50.0),
                dict(step=3, sender_id="B", receiver_id="A", amount=50.0),
                dict(step=7, sender_id="C", receiver_id="C", amount=5.0)])
    got = sorted((r["account_id"], r["step_start"]) for r in rows_of(D.round_trip(L)))
    assert got == [("A", 3), ("B", 3), ("C", 7)]


def test_window_edges(ledger):
    # drain gap 5 fires, 6 does not
    for gap, n in ((5, 1), (6, 0)):
        L = ledger([dict(step=1, sender_id="A", amount=1.0, sender_balance_before=100.0,
                         sender_balance_after=99.0),
                    dict(step=1 + gap, sender_id="A", amount=1.0, sender_balance_before=10.0,
                         sender_balance_after=5.0)])
        assert D.rapid_drain(L).count() == n
    # round trip gap 10 fires, 11 does not
    for gap, n in ((10, 1), (11, 0)):
        L = ledger([dict(step=1, sender_id="A", receiver_id="B", amount=10.0),
                    dict(step=1 + gap, sender_id="B", receiver_id="A", amount=10.0)])
        assert D.round_trip(L).count() == n
    # velocity: 9 participations within 10 steps (span 9) fire, span 10 does not
    for last, n in ((9, 1), (10, 0)):
        rows = [dict(step=s, sender_id="V", receiver_id=f"R{s}") for s in range(1, 9)]
        rows.append(dict(step=last + 1, sender_id="V", receiver_id="RX"))
        acc = [r["account_id"] for r in D.high_velocity(ledger(rows)).collect()]
        assert ("V" in acc) == bool(n)


def test_zero_first_leg_no_division_error(ledger):
    L = ledger([dict(step=1, sender_id="A", receiver_id="B", amount=0.0),
                dict(step=2, sender_id="B", receiver_id="A", amount=0.0)])
    assert D.round_trip(L).count() == 0


def test_median_even_and_strict(ledger):
    # amounts 1, 2, 3, 4 -> median 2.5, threshold 5.0; amount exactly 5 does not fire
    L = ledger([dict(step=i, sender_id=f"S{i}", receiver_id=f"R{i}", amount=a)
                for i, a in enumerate([1.0, 2.0, 3.0, 4.0, 5.0, 5.1], start=1)])
    med = D.amount_median(L).collect()[0]["median"]
    assert med == 3.5
    out = sorted(r["amount"] for r in D.dormant_activation(L).collect())
    assert out == []
    L2 = ledger([dict(step=i, sender_id=f"S{i}", receiver_id=f"R{i}", amount=a)
                 for i, a in enumerate([1.0, 2.0, 3.0, 4.0, 5.0, 7.5], start=1)])
    assert sorted(r["amount"] for r in D.dormant_activation(L2).collect()) == [7.5]


def test_empty_and_missing_columns(spark, ledger):
    L = ledger([]).limit(0)
    for name, fn in D.DETECTORS.items():
        assert fn(L).count() == 0, name
    assert D.rapid_drain(L.drop("sender_balance_before")).count() == 0


def test_severity_and_payload(ledger):
    L = ledger([dict(step=1, amount=100.0, sender_balance_before=1000.0,
                     sender_balance_after=800.0)])
    f = with_severity(analyze(L)).collect()[0]
    assert f["severity"] == "high"
    p = to_payload(analyze(L), "c1").collect()[0]
    assert p["account_ids"] == ["DATASET"] and p["case_id"] == "c1"


# ---- random ledgers with many ties against the row-loop statement of each rule
def random_rows(seed, n=160, accounts=6, steps=30, negative=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = f"A{rng.randrange(accounts)}"
        r = f"A{rng.randrange(accounts)}"  # self transfers included
        amt = float(rng.choice([0, 5, 10, 10, 20, 50, 100, 101, 98]))
        if negative and rng.random() < 0.2:
            amt = -amt
        before = rng.choice([0.0, 100.0, 200.0, 1000.0, None])
        after = rng.choice([0.0, 5.0, 50.0, 150.0, 900.0, None])
        rows.append(dict(step=rng.randrange(steps), sender_id=s, receiver_id=r, amount=amt,
                         sender_balance_before=before, sender_balance_after=after, row_id=i))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
@pytest.mark.parametrize("negative", [False, True])
def test_detectors_match_row_loops(ledger, seed, negative):
    rows = random_rows(seed, negative=negative)
    L = ledger(rows, partitions=3)
    got = sorted((r["account_id"], r["step_start"], r["step_end"], r["amount"])
                 for r in D.rapid_drain(L).collect())
    assert got == naive.rapid_drain(rows)
    got = sorted((r["account_id"], r["step_start"], r["step_end"], r["amount"])
                 for r in D.round_trip(L).collect())
    assert got == naive.round_trip(rows)
    for role in ("out", "in"):
        got = sorted((r["account_id"], r["step_start"], r["step_end"], r["amount"],
                      int(r["description"].split()[3]))
                     for r in D.fan(L, role, min_distinct=3).collect())
        assert got == naive.fan(rows, role, k=3)
    got = sorted((r["account_id"], r["step_start"], r["amount"])
                 for r in D.dormant_activation(L).collect())
    assert got == naive.dormant(rows)
    got = sorted(r["account_id"] for r in D.high_velocity(L, 5, 6).collect())
    assert got == naive.velocity(rows, 5, 6)


def test_partitioning_does_not_change_findings(ledger):
    rows = random_rows(7)
    shuffled = list(rows)
    random.Random(3).shuffle(shuffled)  # same row ids, other physical order
    a = sorted(map(tuple, analyze(ledger(rows, partitions=1)).collect()))
    b = sorted(map(tuple, analyze(ledger(shuffled, partitions=7)).collect()))
    assert a == b and len(a) > 0


def test_multi_case_analyze_equals_per_case(spark, ledger):
    from pyspark.sql import functions as F
    rows = []
    for c, seed in (("c1", 1), ("c2", 2), ("c3", 3)):
        for r in random_rows(seed, n=120):
            r = dict(r)
            r["row_id"] = r["row_id"] + {"c1": 0, "c2": 1000, "c3": 2000}[c]
            r["tx_type"] = c  # carries the case through the fixture schema
            rows.append(r)
    L = ledger(rows, partitions=4).withColumnRenamed("tx_type", "case_id")
    together = sorted(map(tuple, analyze(L, by=("case_id",)).collect()))
    apart = []
    for c in ("c1", "c2", "c3"):
        one = analyze(L.where(F.col("case_id") == c)).select(F.lit(c).alias("case_id"), "*")
        apart += list(map(tuple, one.collect()))
    assert together == sorted(apart) and len(together) > 10
    vel = sorted(map(tuple, D.high_velocity(L, 5, 4, by=("case_id",)).collect()))
    vel_apart = sorted((c, r["account_id"]) for c in ("c1", "c2", "c3")
                       for r in D.high_velocity(L.where(F.col("case_id") == c), 5, 4).collect())
    assert vel == vel_apart and len(vel) > 0
    meds = {r["case_id"]: r["median"] for r in D.amount_median(L, by=("case_id",)).collect()}
    for c in ("c1", "c2", "c3"):
        assert meds[c] == D.amount_median(L.where(F.col("case_id") == c)).collect()[0]["median"]


def test_hot_account_holding_a_third_of_rows(ledger):
    from ledgerscope.operators import features as FE
    rng = random.Random(99)
    rows = []
    for i in range(1500):
        hot = i % 3 == 0
        s = "HOT" if hot else f"A{rng.randrange(40)}"
        r = f"A{rng.randrange(40)}" if hot or rng.random() < 0.5 else "HOT"
        amt = float(rng.choice([5, 10, 20, 50, 100, 101, 98]))
        rows.append(dict(step=rng.randrange(200), sender_id=s, receiver_id=r, amount=amt,
                         sender_balance_before=float(rng.choice([100, 200, 1000])),
                         sender_balance_after=float(rng.choice([5, 50, 150, 900])), row_id=i))
    L = ledger(rows, partitions=6)
    got = sorted((r["account_id"], r["step_start"], r["step_end"], r["amount"])
                 for r in D.rapid_drain(L).collect())
    assert got == naive.rapid_drain(rows)
    got = sorted((r["account_id"], r["step_start"], r["step_end"], r["amount"])
                 for r in D.round_trip(L).collect())
    assert got == naive.round_trip(rows)
    for role in ("out", "in"):
        got = sorted((r["account_id"], r["step_start"], r["step_end"], r["amount"],
                      int(r["description"].split()[3])) for r in D.fan(L, role).collect())
        assert got == naive.fan(rows, role)
    got = sorted((r["account_id"], r["step_start"], r["amount"])
                 for r in D.dormant_activation(L).collect())
    assert got == naive.dormant(rows)
    a = {r["row_id"]: r["amount_vs_sender_median"] for r in FE.features(L, median_partitions=1).collect()}
    b = {r["row_id"]: r["amount_vs_sender_median"] for r in FE.features(L, median_partitions=7).collect()}
    assert a == b


def test_round_trip_amount_buckets_keep_tolerance_edges(ledger):
    rows, want = [], 0
    for i, a1 in enumerate([0.001, 1.0, 100.0, 12345.67, 1e9]):
        for j, a2 in enumerate([a1 * 0.95, a1 * 1.05, a1 * 0.9499, a1 * 1.0501, a1]):
            s, r = f"S{i}_{j}", f"R{i}_{j}"
            rows.append(dict(step=1, sender_id=s, receiver_id=r, amount=a1))
            rows.append(dict(step=3, sender_id=r, receiver_id=s, amount=a2))
            want += abs(a1 - a2) / a1 <= 0.05
    got = D.round_trip(ledger(rows)).count()
    assert got == want == len(naive.round_trip(rows))


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_row = st.fixed_dictionaries({
    "step": st.integers(0, 12),
    "sender_id": st.sampled_from(["A", "B", "C"]),
    "receiver_id": st.sampled_from(["A", "B", "C", "D", "E", "F", "G"]),
    "amount": st.sampled_from([-5.0, 0.0, 1.0, 10.0, 10.5, 100.0]),
    "sender_balance_before": st.sampled_from([None, 0.0, 10.0, 100.0, 1000.0]),
    "sender_balance_after": st.sampled_from([None, 0.0, 0.5, 5.0, 90.0]),
})


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_row, min_size=1, max_size=40))
def test_property_drain_and_fan_match_row_loops(spark, rows):
    from ledger_rows import make_ledger
    rows = [dict(r, row_id=i) for i, r in enumerate(rows)]
    L = make_ledger(spark, rows, partitions=2)
    got = sorted((r["account_id"], r["step_start"], r["step_end"], r["amount"])
                 for r in D.rapid_drain(L).collect())
    assert got == naive.rapid_drain(rows)
    got = sorted((r["account_id"], r["step_start"], r["step_end"], r["amount"],
                  int(r["description"].split()[3])) for r in D.fan(L, "out", min_distinct=2)
                 .collect())
    assert got == naive.fan(rows, "out", k=2)


def refunds(seed, n, steps):
    """Mostly refunds, a third of the rows one sender's."""
    import random
    rnd = random.Random(seed)
    return [dict(row_id=i, step=rnd.randrange(steps), sender_id="HOT" if i % 3 == 0 else f"s{rnd.randrange(12)}", receiver_id="r",
                 amount=rnd.choice([None, 0.0, -1.0, -2.5, -40.0, 3.0, 5.25, 60.0]),
                 sender_balance_before=rnd.choice([None, 0.0, 5.0, 80.0, 900.0]),
                 sender_balance_after=rnd.choice([None, 0.2, 0.6, 7.0, 70.0, 500.0])) for i in range(n)]


def test_drains_among_refunds_match_row_loops(ledger):
    for seed, n, steps in [(1, 500, 4), (2, 500, 60), (3, 300, 1), (4, 40, 3)]:
        rows = refunds(seed, n, steps)
        got = sorted((r["account_id"], r["step_start"], r["step_end"], r["amount"])
                     for r in D.rapid_drain(ledger(rows, partitions=3)).collect())
        assert got == naive.rapid_drain(rows), seed
    # only refunds: no sum is positive, whatever the balances
    assert D.rapid_drain(ledger([dict(r, amount=-1.0) for r in refunds(5, 200, 5)])).count() == 0


def test_cover_and_staircase(spark):
    import random
    rnd = random.Random(6)
    spans = [(0, 0), (5, 5), (0, 15), (3, 300), (16, 31), (255, 4096)] + [(x, x + rnd.randrange(600)) for x in rnd.choices(range(900), k=60)]
    for height in (0, 1, 3):
        df = spark.createDataFrame(spans, "lo long, hi long").select("lo", "hi", D._cover(F.col("lo"), F.col("hi"), height).alias("n"))
        for r in df.collect():
            held = [p for x in r["n"] for p in range(x["node"] << 4 * x["level"], (x["node"] + 1) << 4 * x["level"])]
            assert sorted(held) == list(range(r["lo"], r["hi"] + 1))
            assert height == 0 or len(r["n"]) <= 32 * height + (r["hi"] >> 4 * height) + 1
    points = [(rnd.randrange(9), rnd.randrange(9) / 2) for _ in range(40)]
    got = spark.createDataFrame([(points,)], "p array<struct<s:long,a:double>>").select(D._staircase(F.col("p")).alias("f")).first()["f"]
    want = {p for p in points if not any((q[0] >= p[0] and q[1] <= p[1]) and q != p for q in points)}
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_round_trip_counts_equal_the_pairs(ledger):
    import random
    from collections import Counter
    rnd = random.Random(12)
    for gap, tol in [(10, 0.05), (0, 0.0), (3, 0.5)]:
        rows = [dict(step=rnd.randrange(40), sender_id=(s := rnd.choice("AB")), receiver_id=rnd.choice("AB" if rnd.random() < 0.2 else "BA"[s == "B"]),
                     amount=rnd.choice([None, -3.0, 0.0, 100.0, 95.0, 105.0, 94.99999, 105.00001, 0.1, 0.105, 0.095, rnd.uniform(90, 110)]))
                for _ in range(250)]
        L = ledger(rows, partitions=3)
        want = Counter()
        for x in (dict(r, i=i) for i, r in enumerate(rows)):
            for y in rows:
                if (x["sender_id"], x["receiver_id"]) == (y["receiver_id"], y["sender_id"]) and x["amount"] and x["amount"] > 0 \
                        and y["amount"] is not None and 0 <= y["step"] - x["step"] <= gap and abs(x["amount"] - y["amount"]) / x["amount"] <= tol:
                    want[x["i"]] += 1
        got = D.round_trip_counts(L, gap, tol).collect()
        assert {r["row_id"]: r["n_matches"] for r in got} == dict(want) and len(got) == len(want)
        assert sum(want.values()) == D.round_trip(L, gap, tol).count()
        for r in got:
            match = [y for y in rows if (r["account_id"], r["counterparty"]) == (y["receiver_id"], y["sender_id"]) and y["amount"] == r["match_amount"]
                     and y["step"] == r["match_step"]]
            assert match and abs(r["amount"] - r["match_amount"]) / r["amount"] <= tol and 0 <= r["match_step"] - r["step"] <= gap


def test_round_trip_counts_of_a_pair_with_100000_trades(spark):
    """All pairs would be 2.5 billion findings."""
    n = 100_000
    odd = F.col("id") % 2 == 1
    L = spark.range(n).select(F.col("id").alias("row_id"), F.lit(5).cast("long").alias("step"), F.lit(100.0).alias("amount"),
                              F.when(odd, "A").otherwise("B").alias("sender_id"), F.when(odd, "B").otherwise("A").alias("receiver_id"))
    got = D.round_trip_counts(L).groupBy("n_matches", "match_step").count().collect()
    assert [tuple(r) for r in got] == [(n // 2, 5, n)]


def test_round_trip_counts_shuffle_rows_once_and_large_places_alike(spark, ledger, monkeypatch):
    """One sort within partitions and no checkpoint of exploded rows; places too large to hold give the same rows;
    rows without a row_id, equal rows, and blocks smaller than a place, too."""
    import random
    from ledgerscope.operators import leg_counts
    rnd = random.Random(5)
    rows = [(rnd.choice([None, 1, 2]), rnd.randrange(-300, 300), rnd.choice("AB"), rnd.choice("AB"), float(rnd.choice([100, 104, 106, 0, -1, float("nan")])), i % 7 or None)
            for i in range(900)]
    L = spark.createDataFrame(rows + rows[:200], "case_id int, step int, sender_id string, receiver_id string, amount double, row_id int").repartition(3)
    call = lambda: D.round_trip_counts(L, by=("case_id",))      # noqa: E731
    plan = call()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Window" not in plan and "Aggregate" not in plan
    want = sorted(map(tuple, call().collect()), key=str)
    assert len(want) > 300
    monkeypatch.setattr(D, "_HELD_ROWS", 0)
    assert sorted(map(tuple, call().collect()), key=str) == want
    monkeypatch.setattr(D, "_HELD_ROWS", 20)
    monkeypatch.setattr(D, "counter", lambda *a: leg_counts.counter(*a, size=3))
    assert sorted(map(tuple, call().collect()), key=str) == want


def _row_exchanges(df) -> int:
    """Shuffles of the plan before a row is aggregated away: those by an explicit repartition."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.replace("JoinHint", "")
    return plan.count("RepartitionByExpression")


def test_drain_and_fan_shuffle_the_rows_once(spark):
    """No join back to the rows: one repartition by (account, stretch of time), windows inside it."""
    led = spark.createDataFrame(
        [(i % 40, i, 1.0 + i, f"a{i % 5}", 100.0, 1.0, f"b{i % 9}") for i in range(200)],
        "step long, row_id long, amount double, sender_id string, sender_balance_before double, "
        "sender_balance_after double, receiver_id string")
    assert _row_exchanges(D.rapid_drain(led)) == 1
    assert _row_exchanges(D.fan_out(led)) == 1
    assert _row_exchanges(D.fan_in(led)) == 1


def test_windows_over_the_edges_of_stretches(spark):
    """Bands and windows that begin in one stretch of time and end in the next, and negative steps."""
    import random
    rng = random.Random(7)
    rows = [(rng.randint(-120, 420), i, rng.choice([1.0, 5.0, 20.0, -4.0]), f"a{rng.randint(0, 3)}", rng.choice([0.0, 10.0, 900.0]),
             rng.choice([0.5, 40.0, 80.0, 95.0]), f"b{rng.randint(0, 30)}") for i in range(700)]
    led = spark.createDataFrame(rows, "step long, row_id long, amount double, sender_id string, sender_balance_before double, "
                                      "sender_balance_after double, receiver_id string")
    want = {}
    for acct in {r[3] for r in rows}:
        mine = sorted(r for r in rows if r[3] == acct)
        starts = []
        for s in sorted({r[0] for r in mine}):
            inside = [r for r in mine if s <= r[0] <= s + 10]
            if len({r[6] for r in inside}) > 5:
                starts.append((acct, s, max(r[0] for r in inside), sum(r[2] for r in inside)))
        if starts:
            want[acct] = starts[0]
    got = {r["account_id"]: (r["account_id"], r["step_start"], r["step_end"], r["amount"]) for r in D.fan_out(led).collect()}
    assert got == want and want
    drains = {}
    for acct in {r[3] for r in rows}:
        mine = sorted(r for r in rows if r[3] == acct)
        pairs = [(i, j) for i in range(len(mine)) for j in range(i, len(mine))
                 if mine[j][0] - mine[i][0] <= 5 and mine[i][4] > 0 and mine[j][5] < 0.1 * mine[i][4]
                 and sum(r[2] for r in mine[i:j + 1]) > 0]
        if pairs:
            i, j = min(pairs)
            drains[acct] = (mine[i][0], mine[j][0], sum(r[2] for r in mine[i:j + 1]))
    assert {r["account_id"]: (r["step_start"], r["step_end"], r["amount"]) for r in D.rapid_drain(led).collect()} == drains


def test_median_by_bracket_is_exact(spark):
    for values in ([3.0], [2.0, 1.0], [5.0] * 9 + [1.0], [float(i * i % 997) for i in range(5000)], [None, 4.0, float("nan")], [None]):
        led = spark.createDataFrame([(v,) for v in values], "amount double")
        known = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
        n = len(known)
        got = D.amount_median(led).collect()
        want = (known[(n - 1) // 2] + known[n // 2]) / 2 if n else None
        assert len(got) == 1 and (got[0]["median"] == want or (want != want and got[0]["median"] != got[0]["median"]))


def test_dormant_ties_at_the_third_place(spark, ledger):
    rng = random.Random(11)
    rows = [{"step": rng.choice([None, 1, 2, 3, 4, 9]), "amount": float(rng.choice([1, 2, 3, 50, 60])),
             "sender_id": f"A{rng.randrange(25)}", "receiver_id": f"A{rng.randrange(25)}"} for _ in range(160)]
    L = ledger(rows, 5)
    med = sorted(r["amount"] for r in rows)
    med = (med[79] + med[80]) / 2
    seen, want = {}, []
    for i in sorted(range(160), key=lambda i: (-1 if rows[i]["step"] is None else rows[i]["step"], i)):
        for slot, a in enumerate((rows[i]["sender_id"], rows[i]["receiver_id"])):
            seen[a] = seen.get(a, 0) + 1
            if slot == 0 and seen[a] <= 3 and rows[i]["amount"] > 2 * med:
                want.append((a, rows[i]["step"] or -1, rows[i]["amount"]))
    got = [(r["account_id"], r["step_start"] or -1, r["amount"]) for r in D.dormant_activation(L).collect()]
    assert sorted(got) == sorted(want) and want
    both = L.select("*", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("case_id"))
    got = [(r["account_id"], r["step_start"] or -1, r["amount"])
           for r in D.dormant_activation(both, by=("case_id",)).where("case_id = 'y'").collect()]
    assert sorted(got) == sorted(want)


def test_dormant_without_ties_and_one_way_pairs_shuffle_little(spark, ledger):
    L = ledger([{"step": i, "amount": float(1 + i % 7), "sender_id": f"A{i % 9}", "receiver_id": f"B{i % 9}"} for i in range(90)]
               + [{"step": 85, "amount": 6.0, "sender_id": "B1", "receiver_id": "A1"}])
    assert "row_id" not in D.dormant_activation(L)._jdf.queryExecution().executedPlan().toString()
    trips = D.round_trip(L)
    assert "LeftSemi" in trips._jdf.queryExecution().optimizedPlan().toString()
    assert [r["account_id"] for r in trips.collect()] == ["A1"]


def test_medians_of_groups_by_bracket(spark):
    from ledgerscope.functions import core
    df = spark.range(60000).selectExpr("cast(id % 3 as string) as g", "id % 1000 / 8.0 as v", "id").select(
        F.when(F.col("id") % 50 != 0, F.col("g")).alias("g"), F.when(F.col("id") % 7 != 0, F.col("v")).alias("v"))
    known = df.where("v is not null and g is not null")
    want = {r["g"]: r["m"] for r in known.groupBy("g").agg(F.expr("median(v)").alias("m")).collect()}
    assert {r["g"]: r["median"] for r in core._bracketed_medians(known, "v", ["g"]).collect()} == want
    assert {r["g"]: r["median"] for r in core.exact_median(df, "v", by=("g",)).collect()} == want


@pytest.mark.parametrize("bits", [28, 12])
def test_only_rows_that_may_fire_are_shuffled(ledger, monkeypatch, bits):
    """Sparse, steady and hot accounts over long times, positive amounts: the same findings from few of the rows,
    also where many hashes of places collide."""
    rng = random.Random(11)
    rows = []
    for i in range(2400):
        s = "HOT" if i % 3 == 0 else f"s{rng.randrange(4)}" if i % 3 == 1 else f"c{rng.randrange(300)}"
        rows.append(dict(row_id=i, step=rng.randrange(-300, 3000), sender_id=s, receiver_id="r0" if i % 4 == 1 else f"r{rng.randrange(40)}",
                         amount=rng.choice([1e-9, 5.0, 20.0]) if s == "s0" else rng.choice([5.0, 20.0]),
                         sender_balance_before=rng.choice([None, 10.0, 100.0, 900.0]),
                         sender_balance_after=rng.choice([None, 1.0, 9.0, 12.0, 95.0, 850.0])))
    monkeypatch.setattr(D, "_HASH_BITS", bits)
    L = ledger(rows, partitions=3)
    got = sorted((r["account_id"], r["step_start"], r["step_end"], r["amount"]) for r in D.rapid_drain(
        L.where("sender_id != 's0'")).collect())
    assert got == naive.rapid_drain([r for r in rows if r["sender_id"] != "s0"])
    for role in ("out", "in"):
        got = sorted((r["account_id"], r["step_start"], r["step_end"], r["amount"], int(r["description"].split()[3]))
                     for r in D.fan(L, role).collect())
        assert got == naive.fan(rows, role) and got
    if bits == 28:
        narrow = L.selectExpr("sender_id as acct", "receiver_id as cpty", "step", "amount")
        assert D._fan_rows(narrow, ["acct"], 10, 5).count() < len(rows) / 4
        listed, core = D._stretches(5, 8)
        listed = L.select("sender_id", "step", "amount", F.col("sender_balance_before").alias("b"),
                          F.col("sender_balance_after").alias("a"), F.explode(listed).alias("stretch"))
        kept, signed = D._drain_rows(listed, core, ["sender_id"], 0.1)
        assert kept.count() < len(rows) / 4 and not signed


def test_level_never_falls(spark):
    values = [float("-inf"), -1e300, -1.0, -0.0, 0.0, 5e-324, 1e-300, 0.5, 1.0, 1.0000001, 2.0, 99.99, 100.0, 1e300, float("inf"), float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(D._level(F.col("x"))).collect()]
    assert got == sorted(got) and None not in got
