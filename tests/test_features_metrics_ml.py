import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import features as FE
from ledgerscope.operators import metrics as M
from ledgerscope.operators import ml as ML
from ledgerscope.schemas import FEATURE_COLUMNS


def test_features_fixture(ledger):
    rows = []
    for i in range(20):
        rows.append(dict(step=i + 1, tx_type="TRANSFER" if i % 2 else "PAYMENT",
                         sender_id="A" if i % 2 else "B", receiver_id="X" if i % 2 == 0 else "Y",
                         amount=100.0 + i, sender_balance_before=1000.0 - i,
                         sender_balance_after=900.0 - i))
    f = FE.features(ledger(rows)).orderBy("row_id").collect()
    assert len(f) == 20
    assert all(c in f[0].asDict() for c in FEATURE_COLUMNS)
    assert all(r[c] is not None for r in f for c in FEATURE_COLUMNS)
    x_prior = [r["receiver_prior_tx_count"] for r in f if r["receiver_id"] == "X"]
    assert x_prior == [float(i) for i in range(10)]
    assert f[0]["sender_tx_velocity"] == 0.0
    # B sends at steps 1, 3, 5, ...: at step 11 the window [1, 10] holds 5 of its rows
    b = [r for r in f if r["sender_id"] == "B"]
    assert b[5]["step"] == 11 and b[5]["sender_tx_velocity"] == 5.0
    # historical median of B's previous amounts 100, 102, 104 -> 102
    assert b[3]["amount_vs_sender_median"] == b[3]["amount"] / (102.0 + 1.0)
    assert b[0]["amount_vs_sender_median"] == b[0]["amount"] / 1.0


def test_same_step_rows_excluded_from_velocity(ledger):
    rows = [dict(step=5, sender_id="A", receiver_id="R", amount=1.0) for _ in range(3)]
    rows.append(dict(step=15, sender_id="A", receiver_id="R", amount=1.0))
    rows.append(dict(step=16, sender_id="A", receiver_id="R", amount=1.0))
    v = [r["sender_tx_velocity"] for r in FE.features(ledger(rows)).orderBy("row_id").collect()]
    assert v == [0.0, 0.0, 0.0, 3.0, 1.0]


def brute_metrics(scores, labels):
    P = sum(labels)
    N = len(labels) - P
    ths = sorted(set(scores), reverse=True)
    pts = []
    for t in ths:
        tp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 1)
        fp = sum(1 for s, y in zip(scores, labels) if s >= t and y != 1)
        prec = tp / (tp + fp) if tp + fp else 0.0
        rec = tp / P if P else 1.0
        f1 = 2 * (prec * rec) / (prec + rec) if prec + rec else 0.0
        pos_t = sum(1 for s, y in zip(scores, labels) if s == t and y == 1)
        pts.append((t, tp, fp, prec, rec, f1, pos_t))
    ap = sum(p[6] / P * p[3] for p in pts) if P else 0.0
    best = max(pts, key=lambda p: (p[5], -p[0]))
    pairs = [(sp, sn) for sp, yp in zip(scores, labels) if yp == 1
             for sn, yn in zip(scores, labels) if yn != 1]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / (P * N)
    return dict(best_threshold=best[0], tp=best[1], fp=best[2], auprc=ap, roc_auc=auc)


@pytest.mark.parametrize("seed", [1, 2])
def test_metrics_match_brute_force(spark, seed):
    rng = random.Random(seed)
    data = []
    for m in ("m1", "m2"):
        for _ in range(150):
            y = 1 if rng.random() < 0.2 else 0
            s = round(rng.random() * 0.6 + 0.3 * y, 1)  # coarse: many ties
            data.append((m, s, y))
    df = spark.createDataFrame(data, "model string, score double, label int")
    got = {r["model"]: r for r in M.metrics(df).collect()}
    for m in ("m1", "m2"):
        sc = [s for mm, s, _ in data if mm == m]
        lb = [y for mm, _, y in data if mm == m]
        want = brute_metrics(sc, lb)
        g = got[m]
        assert g["best_threshold"] == want["best_threshold"]
        assert (g["tp"], g["fp"]) == (want["tp"], want["fp"])
        assert abs(g["auprc"] - want["auprc"]) < 1e-12
        assert abs(g["roc_auc"] - want["roc_auc"]) < 1e-12
        assert g["tn"] + g["fp"] + g["fn"] + g["tp"] == len(sc)


def test_stratified_split_and_imbalanced_fit(spark):
    rng = random.Random(0)
    rows = []
    for i in range(500):
        y = 1 if i % 50 == 0 else 0
        f = [rng.gauss(0, 1) + (10.0 if y and j == 0 else 0.0) for j in range(len(FEATURE_COLUMNS))]
        rows.append((i, y, *f))
    schema = "row_id long, label int, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    df = spark.createDataFrame(rows, schema)
    sp = ML.stratified_split(df)
    counts = {(r["label"], r["split"]): r["count"] for r in sp.groupBy("label", "split").count()
              .collect()}
    assert counts[(1, "train")] == 7 and counts[(0, "train")] == 343
    assert sum(v for (lab, _), v in counts.items() if lab == 1) == 10
    assert sp.select("split").distinct().count() == 3
    for kind in ML.MODEL_KINDS:
        model = ML.train(sp, kind, max_iter=50)
        test = ML.score(model, sp, kind)
        tp = test.where((F.col("label") == 1) & (F.col("score") >= 0.5)).count()
        assert tp >= 1, kind
    with pytest.raises(ValueError):
        ML.train(sp, "unknown")
    with pytest.raises(RuntimeError):
        ML.save(None, "/tmp/nowhere")
    imp = ML.feature_importance(ML.train(sp, "random_forest")).collect()
    assert imp[0]["feature"] == FEATURE_COLUMNS[0] and len(imp) == 13


def test_rank_accounts(spark):
    df = spark.createDataFrame([("A", "B", 0.9), ("B", "C", 0.2), ("C", "A", 0.5)],
                               "sender_id string, receiver_id string, score double")
    r = ML.rank_accounts(df, top=2).collect()
    assert [(x["account_id"], x["max_fraud_probability"], x["tx_count"]) for x in r] == \
        [("A", 0.9, 2), ("B", 0.9, 2)]


def test_hot_sender_median_is_the_same_in_one_chunk_and_in_many(ledger):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        s = "HOT" if i % 3 else f"c{i % 7}"
        amt = None if i % 37 == 0 else float(rng.choice([1, 2, 2, 3, 5, 8, 13, 100]))
        rows.append(dict(step=rng.randrange(40), sender_id=s, receiver_id=f"r{i % 5}", amount=amt,
                         sender_balance_before=10.0, sender_balance_after=5.0))
    L = ledger(rows, partitions=3)
    cold = {r["row_id"]: r["amount_vs_sender_median"] for r in FE.features(L, median_partitions=1).collect()}
    hot = {r["row_id"]: r["amount_vs_sender_median"] for r in FE.features(L, median_partitions=13).collect()}
    assert cold.keys() == hot.keys()
    assert all((cold[k] is None and hot[k] is None) or cold[k] == hot[k] for k in cold)


def test_evaluate_all_writes_models_and_metrics(spark, ledger):
    import os
    import tempfile
    rng = random.Random(3)
    rows = []
    for i in range(400):
        fraud = i % 20 == 0
        rows.append(dict(step=rng.randrange(50), sender_id=f"S{rng.randrange(30)}",
                         receiver_id=f"R{rng.randrange(30)}", amount=5000.0 if fraud else 10.0 + i,
                         sender_balance_before=5000.0 if fraud else 1000.0,
                         sender_balance_after=0.0 if fraud else 900.0, is_fraud=fraud))
    out = tempfile.mkdtemp(prefix="ls-eval-")
    m = {r["model"]: r for r in ML.evaluate_all(ledger(rows), out, max_iter=50).collect()}
    assert set(m) == {"logistic", "random_forest", "gbt"}
    assert all(0.0 <= r["roc_auc"] <= 1.0 for r in m.values())
    assert set(os.listdir(out)) >= {"logistic_model", "random_forest_model", "gbt_model", "metrics"}
    assert len(spark.read.json(out + "/metrics").collect()) == 3


def test_boosting_stops_where_a_plain_loop_does(spark):
    import math

    from pyspark.ml.functions import vector_to_array

    from ledgerscope.operators import ml as ML
    assert ML.best_round([5, 4, 3, 3, 3.5], 2) == (3, True) and ML.best_round([3, 2, 1], 2) == (3, False)
    assert ML.best_round([1] + [2] * 10 + [0], 10) == (1, True)
    rng = random.Random(3)
    rows = []
    for i in range(900):
        x = [rng.gauss(0, 1) for _ in ML.FEATURE_COLUMNS]
        rows.append((*x, int(x[0] + x[1] * x[2] + rng.gauss(0, 1.5) > 1), ("train", "train", "val")[i % 3]))
    df = spark.createDataFrame(rows, [*ML.FEATURE_COLUMNS, "label", "split"])
    model = ML.train(df, "gbt")
    trees = model.stages[-1].getNumTrees
    d = model.stages[0].transform(df.where("split <> 'test'"))
    pos = df.where("split = 'train' AND label = 1").count()
    neg = df.where("split = 'train' AND label = 0").count()
    d = d.withColumn("weight", F.when(F.col("label") == 1, neg / pos).otherwise(1.0))
    losses = []
    full = ML._estimator("gbt").copy({ML._estimator("gbt").maxIter: 25}).fit(d.where("split = 'train'"))
    val = d.where("split = 'val'")
    margin = [0.0] * val.count()
    for tree, w in zip(full.trees, full.treeWeights, strict=True):        # one tree after the other
        got = [r[0] for r in tree.transform(val.select("features")).select("prediction").collect()]
        margin = [m + w * g for m, g in zip(margin, got, strict=True)]
        y = [2 * r[0] - 1 for r in val.select("label").collect()]
        losses.append(sum(2 * math.log1p(math.exp(-2 * a * b)) for a, b in zip(y, margin, strict=True)) / len(y))
    best, stop = ML.best_round(losses)
    assert stop and trees == best < 25
    first = [m.toDebugString.split("Tree 1")[0].split("\n", 1)[1].strip() for m in (model.stages[-1], full)]
    assert first[0] == first[1]


def test_boosted_trees_are_cut_and_not_fitted_again(spark, monkeypatch, tmp_path):
    import random
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml import PipelineModel
    rng = random.Random(3)
    rows = []
    for i in range(300):
        x = [rng.gauss(0, 1) for _ in ML.FEATURE_COLUMNS]
        rows.append((*x, int(x[0] + x[1] * x[2] + rng.gauss(0, 1.5) > 1), ("train", "train", "val")[i % 3]))
    df = spark.createDataFrame(rows, [*ML.FEATURE_COLUMNS, "label", "split"])
    fitted, fit = [], GBTClassifier._fit
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, d: fitted.append(self.getMaxIter()) or fit(self, d))
    model = ML.train(df, "gbt")
    assert fitted == [25] and model.stages[-1].getNumTrees < 25
    d = model.stages[0].transform(df.where("split = 'train'").withColumn("weight", F.lit(1.0))).checkpoint()
    est = ML._estimator("gbt")
    again = est.copy({est.maxIter: 4}).fit(d)
    cut = ML._first_rounds(est.copy({est.maxIter: 6}).fit(d), est, 4)
    assert cut.toDebugString.split("\n", 1)[1] == again.toDebugString.split("\n", 1)[1] and cut.treeWeights == again.treeWeights
    assert {p.name: v for p, v in cut.extractParamMap().items()} == {p.name: v for p, v in again.extractParamMap().items()}
    ML.save(PipelineModel(stages=[model.stages[0], cut]), str(tmp_path / "m"))
    scores = [[r["score"] for r in ML.score(m, df).orderBy("amount").select("score").collect()]
              for m in (PipelineModel(stages=[model.stages[0], cut]), PipelineModel(stages=[model.stages[0], again]), ML.load(str(tmp_path / "m")))]
    assert scores[0] == scores[1] == scores[2]


def test_prior_counts_over_stretches_and_rows_without_step(spark, ledger):
    steps = [None, 3, 127, 128, 128, 500, None, 129]
    rows = [{"step": s, "sender_id": f"S{i % 2}", "receiver_id": "R", "amount": 1.0, "sender_balance_before": 9.0,
             "sender_balance_after": 8.0} for i, s in enumerate(steps)]
    out = FE.features(ledger(rows))
    got = {r["row_id"]: (r["receiver_prior_tx_count"], r["sender_tx_velocity"]) for r in out.collect()}
    assert got == {1: (2.0, 0.0), 2: (3.0, 0.0), 3: (4.0, 0.0), 4: (5.0, 1.0), 7: (6.0, 1.0), 5: (7.0, 0.0)}
