from pyspark.sql import functions as F

from ledgerscope.operators import graph as G
from ledgerscope.operators import timeline as T


def graph_rows():
    rows = []
    for i in range(1, 51):
        rows.append(dict(step=i, sender_id=f"C{i}", receiver_id=f"M{i}", amount=10.0))
    for i, c in enumerate(range(51, 61)):
        rows.append(dict(step=55 + i // 2, sender_id="H1", receiver_id=f"C{c}", amount=50.0,
                         is_flagged=True))
    rows.append(dict(step=60, sender_id="H1", receiver_id="C61", amount=200.0, tx_type="TRANSFER"))
    rows.append(dict(step=61, sender_id="C61", receiver_id="C62", amount=150.0))
    rows.append(dict(step=62, sender_id="C62", receiver_id="C63", amount=100.0))
    for i in range(1, 38):
        rows.append(dict(step=70 + i, sender_id=f"C{i}", receiver_id="BANK", amount=1.0))
    return rows


def test_graph_build_ego_centrality_velocity(ledger):
    from ledgerscope.operators.detectors import high_velocity
    L = ledger(graph_rows())
    V = {r["account_id"]: r for r in G.vertices(L).collect()}
    assert V["H1"]["tx_count"] == 11 and V["H1"]["total_sent"] == 700.0
    assert V["H1"]["total_received"] == 0.0 and V["H1"]["is_flagged"]
    E = G.edges(L)
    e = E.where("sender_id = 'H1' AND receiver_id = 'C61'").collect()[0]
    assert (e["amount"], e["step"], e["tx_type"]) == (200.0, 60, "TRANSFER")
    seeds = L.sparkSession.createDataFrame([("C61",)], "account_id string")
    d1 = {r["node"] for r in G.ego_nodes(E, seeds, depth=1).collect()}
    assert d1 == {"C61", "H1", "C62"}
    d2 = {r["node"] for r in G.ego_nodes(E, seeds, depth=2).collect()}
    assert {"C63", "C51"} <= d2
    cen = {r["account_id"]: r for r in G.degree_centrality(G.vertices(L), E).collect()}
    assert cen["H1"]["out_degree"] > 0 and cen["H1"]["in_degree"] == 0
    assert cen["BANK"]["in_degree"] > 0 and cen["BANK"]["out_degree"] == 0
    n = len(V)
    assert cen["H1"]["degree"] == 11 / (n - 1)
    vel = {r["account_id"] for r in high_velocity(L).collect()}
    assert "H1" in vel and "C1" not in vel
    nodes, edges = G.ego_network(E, G.vertices(L), seeds)
    sn, se = G.styled(nodes, edges)
    colors = {r["node"]: r["color"] for r in sn.collect()}
    assert colors["H1"] == "red" and colors["C61"] == "steelblue"
    widths = {(r["sender_id"], r["receiver_id"]): r["edge_width"] for r in se.collect()}
    assert abs(widths[("H1", "C61")] - 5.298317366548036) < 1e-12


def test_last_row_wins_and_self_loop(ledger):
    L = ledger([dict(step=1, sender_id="A", receiver_id="B", amount=1.0),
                dict(step=9, sender_id="A", receiver_id="B", amount=2.0),
                dict(step=3, sender_id="A", receiver_id="B", amount=3.0),
                dict(step=4, sender_id="A", receiver_id="A", amount=4.0)])
    E = {(r["sender_id"], r["receiver_id"]): r for r in G.edges(L).collect()}
    assert E[("A", "B")]["amount"] == 3.0  # last in input order, not by step
    cen = {r["account_id"]: r for r in G.degree_centrality(G.vertices(L), G.edges(L)).collect()}
    assert (cen["A"]["in_deg"], cen["A"]["out_deg"]) == (1, 2)


def timeline_rows():
    return [
        dict(step=1, tx_type="CASH_IN", sender_id="A", receiver_id="B", amount=100.0,
             sender_balance_before=1000.0, sender_balance_after=900.0,
             receiver_balance_before=0.0, receiver_balance_after=100.0),
        dict(step=2, tx_type="TRANSFER", sender_id="A", receiver_id="C", amount=500.0,
             sender_balance_before=900.0, sender_balance_after=5.0,
             receiver_balance_before=0.0, receiver_balance_after=500.0, is_flagged=True),
        dict(step=3, tx_type="CASH_OUT", sender_id="B", receiver_id="A", amount=50.0,
             sender_balance_before=100.0, sender_balance_after=50.0,
             receiver_balance_before=5.0, receiver_balance_after=55.0),
    ]


def test_timeline_views_annotations_narrative(spark, ledger):
    L = ledger(timeline_rows())
    ev = T.timeline(L).where("account_id = 'A'").orderBy("step").collect()
    assert [e["event_type"] for e in ev] == ["CASH_IN_SENDER", "TRANSFER_SENDER",
                                             "CASH_OUT_RECEIVER"]
    assert (ev[2]["counterparty"], ev[2]["balance_before"], ev[2]["balance_after"]) == \
        ("B", 5.0, 55.0)
    findings = spark.createDataFrame(
        [("A", "rapid_drain", 1, 2, 0), ("A", "dormant_activation", 3, 3, 4),
         ("A", "fan_out", 1, 3, 2)],
        "account_id string, pattern string, step_start long, step_end long, detector_seq int")
    ann = {r["step"]: r["annotation"] for r in
           T.annotate(T.timeline(L).where("account_id = 'A'"), findings).collect()}
    assert ann[1] == "[RAPID DRAIN]"
    assert ann[2] == "[RAPID DRAIN] [ACCOUNT DRAINED] [FLAGGED BY PAYSIM]"
    assert ann[3] == "[DORMANT ACTIVATION]"
    nar = T.narratives(T.timeline(L).where("account_id = 'A'"), findings).collect()[0]["narrative"]
    assert "account A" in nar and "step 1" in nar and "650.00" in nar and "rapid drain" in nar
    none = spark.createDataFrame([], findings.schema)
    nar2 = T.narratives(T.timeline(L), none).where("account_id = 'A'").collect()[0]
    assert nar2["primary_pattern"] == "flagged transactions" and nar2["first_suspicious_step"] == 2
    accs = spark.createDataFrame([("ZZ",)], "account_id string")
    miss = T.narratives(T.timeline(L), none, accs).collect()[0]["narrative"]
    assert miss == "No transaction events found for account ZZ."


def test_self_transfer_one_event(ledger):
    L = ledger([dict(step=1, sender_id="A", receiver_id="A", amount=5.0)])
    assert T.timeline(L).count() == 1


def brandes(nodes, edges):
    from collections import deque
    succ = {v: [] for v in nodes}
    for a, b in edges:
        if a != b:
            succ[a].append(b)
    bc = {v: 0.0 for v in nodes}
    for s in nodes:
        order, pred = [], {v: [] for v in nodes}
        sig, dist = {v: 0 for v in nodes}, {v: -1 for v in nodes}
        sig[s], dist[s] = 1, 0
        q = deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in succ[v]:
                if dist[w] < 0:
                    q.append(w)
                    dist[w] = dist[v] + 1
                if dist[w] == dist[v] + 1:
                    sig[w] += sig[v]
                    pred[w].append(v)
        dl = {v: 0.0 for v in nodes}
        while order:
            w = order.pop()
            for v in pred[w]:
                dl[v] += sig[v] / sig[w] * (1 + dl[w])
            if w != s:
                bc[w] += dl[w]
    n = len(nodes)
    return {v: bc[v] / ((n - 1) * (n - 2)) for v in nodes}


BRANDES = brandes


def test_betweenness_matches_brandes(spark):
    import random
    rng = random.Random(5)
    edges = sorted({(f"N{rng.randrange(10)}", f"N{rng.randrange(10)}") for _ in range(30)})
    E = spark.createDataFrame(edges, "sender_id string, receiver_id string")
    nodes = sorted({a for e in edges for a in e})
    V = spark.createDataFrame([(x,) for x in nodes], "account_id string")
    got = {r["account_id"]: r["betweenness"] for r in G.betweenness(E, V).collect()}
    want = brandes(nodes, edges)
    assert max(abs(got[v] - want[v]) for v in nodes) < 1e-12
    est = {r["account_id"]: r["betweenness"] for r in G.betweenness(E, V, sources=len(nodes))
           .collect()}
    assert max(abs(est[v] - want[v]) for v in nodes) < 1e-12


def leafy(seed, core=8, leaves=14):
    import random
    rng = random.Random(seed)
    edges = {(f"N{rng.randrange(core)}", f"N{rng.randrange(core)}") for _ in range(2 * core)}
    for i in range(leaves):
        a, b = f"L{i}", f"N{rng.randrange(core)}"
        edges |= set(rng.choice([[(a, b)], [(b, a)], [(a, b), (b, a)]]))
    edges |= {("P1", "P2"), ("Q1", "Q2"), ("Q2", "Q1"), ("C1", "C2"), ("C2", "C3")}
    return sorted(edges)


def test_folded_betweenness_matches_brandes(spark):
    for seed in (1, 2, 3):
        edges = leafy(seed)
        nodes = sorted({a for e in edges for a in e} | {"ALONE"})
        E = spark.createDataFrame(edges, "sender_id string, receiver_id string")
        V = spark.createDataFrame([(x,) for x in nodes], "account_id string")
        want = brandes(nodes, edges)
        got = {r["account_id"]: r["betweenness"] for r in G.betweenness(E, V).collect()}
        assert got.keys() == want.keys() and max(abs(got[v] - want[v]) for v in nodes) < 1e-12
        core, leaves = G.fold_leaves(E.select(F.col("sender_id").alias("v"), F.col("receiver_id").alias("w")).where("v <> w"))
        assert {r["leaf"] for r in leaves.collect()} >= {f"L{i}" for i in range(14)} | {"P2", "Q2", "C1", "C3"}
        assert not {r["leaf"] for r in leaves.collect()} & {x for r in core.collect() for x in r}


def test_estimated_betweenness_keeps_its_error(spark):
    import random
    rng = random.Random(9)
    edges = sorted({(f"N{rng.randrange(20)}", f"N{rng.randrange(20)}") for _ in range(50)}
                   | {(f"L{i}", f"N{i % 5}") for i in range(250)} | {(f"N{i % 5}", f"M{i}") for i in range(230)})
    nodes = sorted({a for e in edges for a in e})
    E = spark.createDataFrame(edges, "sender_id string, receiver_id string")
    V = spark.createDataFrame([(x,) for x in nodes], "account_id string")
    want = brandes(nodes, edges)
    out = G.betweenness_estimate(E, V, error=0.25, batch=100).collect()
    assert {r["account_id"] for r in out} == set(nodes)
    assert 100 <= out[0]["samples"] < len(nodes) and all(0 < r["error"] <= 0.25 for r in out)
    assert all(abs(r["betweenness"] - want[r["account_id"]]) <= r["error"] for r in out)
    assert len({r["error"] for r in out}) > 1                     # vertices that vary less have less
    full = G.betweenness_estimate(E, V, error=1e-6, batch=400).collect()
    assert {r["error"] for r in full} == {0.0}
    assert max(abs(r["betweenness"] - want[r["account_id"]]) for r in full) < 1e-12


def written_bytes(spark, run):
    """Bytes of the checkpoint folder that a call adds."""
    import os
    from ledgerscope.session import checkpoint_dir
    top = checkpoint_dir(spark).removeprefix("file:")

    def size():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(top) for f in fs)
    before = size()
    run()
    return size() - before


def test_betweenness_keeps_nothing_per_source_and_vertex(spark, monkeypatch):
    """The searches inside tasks equal those in levels, in parts and without kept ends, too; 250 sources x 250
    vertices are not written."""
    import random
    import numpy as np
    from ledgerscope.operators import brandes
    rng = random.Random(3)
    edges = sorted({(f"N{rng.randrange(250)}", f"N{rng.randrange(250)}") for _ in range(1500)} | {(f"K{i}", f"K{i + 1}") for i in range(40)})
    E = spark.createDataFrame(edges, "sender_id string, receiver_id string")
    nodes = sorted({a for e in edges for a in e})
    V = spark.createDataFrame([(x,) for x in nodes], "account_id string")
    got = {}
    assert written_bytes(spark, lambda: got.update({r["account_id"]: r["betweenness"] for r in G.betweenness(E, V).collect()})) < 400_000
    want = BRANDES(nodes, edges)
    assert max(abs(got[v] - want[v]) for v in nodes) < 1e-12

    first, to = np.array([0, 2, 4, 5, 6, 6, 6]), np.array([1, 2, 3, 4, 3, 5])
    plain = [x.copy() for x in brandes.Search(first, to, np.arange(6.0)).dependencies(0)]
    assert plain[0].tolist() == [0, 1, 2, 3, 4, 5] and plain[1].tolist() == [20.0, 11.0, 7.0, 9.0, 4.0, 5.0]
    monkeypatch.setattr(brandes, "_AT_ONCE", 1)
    monkeypatch.setattr(brandes, "_KEPT", -1)
    search = brandes.Search(first, to, np.arange(6.0))
    for _ in range(2):
        assert all((x == y).all() for x, y in zip(search.dependencies(0), plain))


def test_estimated_betweenness_keeps_nothing_per_source_and_vertex(spark):
    import random
    rng = random.Random(4)
    edges = sorted({(f"N{rng.randrange(250)}", f"N{rng.randrange(250)}") for _ in range(1500)})
    E = spark.createDataFrame(edges, "sender_id string, receiver_id string")
    nodes = sorted({a for e in edges for a in e})
    V = spark.createDataFrame([(x,) for x in nodes], "account_id string")
    got, want = [], BRANDES(nodes, edges)
    assert written_bytes(spark, lambda: got.extend(G.betweenness_estimate(E, V, error=0.01).collect())) < 600_000
    assert all(abs(r["betweenness"] - want[r["account_id"]]) <= r["error"] + 1e-12 for r in got) and len(got) == len(nodes)


def test_betweenness_of_a_graph_too_large_to_send(spark, monkeypatch):
    from ledgerscope.operators import brandes
    monkeypatch.setattr(brandes, "SENT_EDGES", 0)
    edges = leafy(4)
    nodes = sorted({a for e in edges for a in e})
    E = spark.createDataFrame(edges, "sender_id string, receiver_id string")
    V = spark.createDataFrame([(x,) for x in nodes], "account_id string")
    want = BRANDES(nodes, edges)
    got = {r["account_id"]: r["betweenness"] for r in G.betweenness(E, V).collect()}
    assert max(abs(got[v] - want[v]) for v in nodes) < 1e-12


def test_ego_unknown_seed(spark, ledger):
    import pytest
    L = ledger(graph_rows())
    E = G.edges(L)
    seeds = spark.createDataFrame([("C61",), ("NOPE",)], "account_id string")
    assert {r["seed"] for r in G.ego_nodes(E, seeds, depth=1).collect()} == {"C61"}
    with pytest.raises(ValueError):
        G.ego_nodes(E, seeds, depth=1, strict=True)


def test_an_edge_is_one_row_until_its_seeds_are_listed(spark, monkeypatch):
    """The edges meet the bitmaps of their ends as arrays and not block by block; heavy nodes alike."""
    import random
    rng = random.Random(8)
    edges = sorted({(f"N{rng.randrange(150)}", f"N{rng.randrange(150)}") for _ in range(400)})
    E = spark.createDataFrame([(a, b, float(i), i, "T") for i, (a, b) in enumerate(edges)],
                              "sender_id string, receiver_id string, amount double, step int, tx_type string")
    seeds = spark.createDataFrame([(f"N{i}",) for i in range(140)], "account_id string")      # three blocks
    nodes = G.ego_nodes(E, seeds, depth=2)
    inside = {}
    for r in nodes.collect():
        inside.setdefault(r["seed"], set()).add(r["node"])
    want = sorted((s, a, b) for s, near in inside.items() for a, b in edges if a in near and b in near)
    for most in (32, 2, 0):
        monkeypatch.setattr(G, "_LIGHT", most)
        out = G.ego_edges(E, nodes)
        assert sorted((r["seed"], r["sender_id"], r["receiver_id"]) for r in out.collect()) == want
        if most == 32:
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            joins = [x for x in plan.splitlines() if "Join " in x]
            assert joins and not any(" AND " in x for x in joins)          # none by (node, block)


def plain_ego(edges, seeds, depth):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = set()
    for s in set(seeds) & set(near):
        dist, front = {s: 0}, [s]
        for d in range(1, depth + 1):
            front = sorted({w for v in front for w in near[v]} - set(dist))
            dist.update(dict.fromkeys(front, d))
        out |= {(s, v, d) for v, d in dist.items()}
    return out


def test_many_seeds_through_one_hub(spark):
    """1,000 seeds around one hub, next to random edges: as one search per seed finds them."""
    import random
    rng = random.Random(8)
    edges = {(f"S{i}", "HUB") for i in range(1000)} | {("HUB", f"T{i}") for i in range(30)}
    edges |= {(f"S{rng.randrange(1000)}", f"X{rng.randrange(60)}") for _ in range(80)} | {("HUB", "HUB"), ("Y1", "Y2")}
    E = spark.createDataFrame([(a, b, 1.0, 1, "PAYMENT") for a, b in edges],
                              "sender_id string, receiver_id string, amount double, step long, tx_type string")
    names = [f"S{i}" for i in range(1000)] + ["S1", "Y1", "NOPE"]
    seeds = spark.createDataFrame([(x,) for x in names], "account_id string")
    few = spark.createDataFrame([(f"S{i}",) for i in range(0, 1000, 14)] + [("Y1",)], "account_id string")
    got = {tuple(r) for r in G.ego_nodes(E, seeds, depth=1).collect()}
    assert got == plain_ego(edges, names, 1)
    nodes = G.ego_nodes(E, few, depth=4)
    rows = [tuple(r) for r in nodes.collect()]
    want = plain_ego(edges, [r[0] for r in few.collect()], 4)
    assert set(rows) == want and len(rows) == len(want)
    inside = {}
    for s, v, _ in want:
        inside.setdefault(s, set()).add(v)
    got = sorted((r["seed"], r["sender_id"], r["receiver_id"]) for r in G.ego_edges(E, nodes).collect())
    assert got == sorted((s, a, b) for s, vs in inside.items() for a, b in edges if a in vs and b in vs)


def test_a_hubs_edges_are_sent_once_per_block_of_seeds(spark):
    """200 seeds: 4 blocks, so the hub's 500 edges give 2,000 rows and not 100,000."""
    E = spark.createDataFrame([(f"S{i}", "HUB", 1.0, 1, "T") for i in range(200)] + [("HUB", f"T{i}", 1.0, 1, "T") for i in range(300)],
                              "sender_id string, receiver_id string, amount double, step long, tx_type string")
    seeds = G._numbered(spark.createDataFrame([(f"S{i}",) for i in range(200)], "seed string"))
    bits = seeds.groupBy("block").agg(F.bit_or(G._one_bit(F.col("bit"))).alias("bits"))
    sent = bits.withColumn("node", F.lit("HUB")).join(G._undirected(E), "node")
    assert bits.count() == 4 and sent.count() == 2000
    assert G.ego_nodes(E, seeds.select(F.col("seed").alias("account_id")), depth=2).count() == 200 * 501


def test_dyadic_nodes_cover_an_interval_once(spark):
    import random

    from ledgerscope.operators.findings import dyadic_nodes
    rng = random.Random(3)
    spans = [(0, 0), (-5, 7), (0, 2**40), (3, 3 + 31_536_000)] + [(x, x + rng.randrange(200)) for x in rng.choices(range(-100, 300), k=80)]
    df = spark.createDataFrame(spans, "lo long, hi long").withColumn("nodes", dyadic_nodes(F.col("lo"), F.col("hi")))
    for r in df.collect():
        parts = sorted((n["node"] << n["level"], (n["node"] + 1 << n["level"]) - 1) for n in r["nodes"])
        assert parts[0][0] == r["lo"] and parts[-1][1] == r["hi"]
        assert all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
        assert len(parts) <= 2 * (r["hi"] - r["lo"] + 1).bit_length()


def test_interval_join_with_steps_in_seconds(spark):
    import random

    from ledgerscope.operators.findings import interval_join, merge_intervals
    rng = random.Random(4)
    year = 31_536_000
    iv = [(rng.choice(["HOT"] * 3 + ["A", "B"]), s := rng.randrange(year), s + rng.choice([0, 59, 86_400, 40 * 86_400])) for _ in range(60)]
    iv += [("A", year - 5, 2**63 - 1), ("OPEN", 0, 2**63 - 1), ("NONE", 2 * year, 3 * year)]
    pts = [(rng.choice(["HOT"] * 4 + ["A", "B", "OPEN", "C", None]), rng.randrange(year), i) for i in range(600)]
    pts += [("HOT", iv[0][1], 900), ("HOT", iv[0][2], 901), ("A", None, 902), ("HOT", pts[0][1], 903)]
    P = spark.createDataFrame(pts, "account_id string, step long, id long")
    pieces = merge_intervals(spark.createDataFrame(iv, "account_id string, step_start long, step_end long"), ["account_id"])
    got = interval_join(P, pieces, ["account_id"], how="left").collect()
    assert len(got) == len(pts)
    held = {i for a, t, i in pts if t is not None and any(a == b and lo <= t <= hi for b, lo, hi in iv)}
    assert {r["id"] for r in got if r["step_start"] is not None} == held
    assert all(r["step_start"] <= r["step"] <= r["step_end"] for r in got if r["step_start"] is not None)
    assert {r["id"] for r in interval_join(P, pieces, ["account_id"]).collect()} == held
    assert interval_join(P, pieces.limit(0), ["account_id"], how="left").count() == len(pts)


def test_spread_ego_rows_are_not_shuffled(spark):
    """The bitmaps meet their seeds' names and attributes before they become one row per (seed, node)."""
    led = spark.createDataFrame([(f"a{i % 7}", f"b{i}", 1.0, i, "T", i) for i in range(140)],
                                "sender_id string, receiver_id string, amount double, step long, tx_type string, row_id long")
    seeds = spark.createDataFrame([(f"b{i}",) for i in range(130)], "account_id string")
    vertices = G.vertices(led)
    nodes, _ = G.ego_network(G.edges(led), vertices, seeds)
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[:plan.index("Generate explode")]
    rows = nodes.select("seed", "node", "dist").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, G.ego_nodes(G.edges(led), seeds).collect()))
    assert len(rows) == sum(1 + 1 + 19 for _ in range(130))


def test_short_findings_are_met_without_a_lookup_of_all_steps(spark, ledger):
    L = ledger([{"step": i, "sender_id": f"A{i % 3}", "receiver_id": "B", "amount": 1.0} for i in range(12)])
    found = spark.createDataFrame([("A1", "rapid_drain", 2, 5), ("A2", "dormant_activation", 8, 8)],
                                  "account_id string, pattern string, step_start long, step_end long")
    out = T.annotate(T.timeline(L), found)
    assert "shiftright" not in out._jdf.queryExecution().optimizedPlan().toString()
    marked = {(r["account_id"], r["step"]): r["annotation"] for r in out.where("annotation <> ''").collect()}
    assert marked == {("A1", 4): "[RAPID DRAIN]", ("A2", 8): "[DORMANT ACTIVATION]"}
    long_one = found.withColumn("step_end", F.col("step_end") + 500)
    out = T.annotate(T.timeline(L), long_one)
    assert {(r["account_id"], r["step"]) for r in out.where("annotation <> ''").collect()} == {
        ("A1", 4), ("A1", 7), ("A1", 10), ("A2", 8), ("A2", 11)}
