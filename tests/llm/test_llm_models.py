import itertools
import math
import random
import zlib

import numpy as np
import pytest
from helpers import HAVE, documents
from pyspark.sql import functions as F

from ledgerscope.llm import langid as L
from ledgerscope.llm import toxicity as T
from ledgerscope.llm.common import held_out
from ledgerscope.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


def plain_phrases(train, test):
    """Greedy longest-match parse by substring search."""
    n, i = 0, 0
    while i < len(test):
        k = 1
        while i + k < len(test) and test[i:i + k + 1] in train:
            k += 1
        n, i = n + 1, i + k
    return n


def test_phrases_equal_a_greedy_substring_parse():
    rnd = random.Random(5)
    passages = {lang: ["".join(rnd.choice("abcde ") for _ in range(90)) for _ in range(3)] for lang in ("x", "y")}
    model = L.Model(passages)
    texts = ["".join(rnd.choice("abcdeéz  .") for _ in range(n)) for n in (1, 7, 60, 400, 511, 512, 513, 1400)]
    counts, n = model.phrases(texts)
    for j, t in enumerate(texts):
        sym = model.symbols([t])[0].tolist()
        assert n[j] == len(sym)
        for k, lang in enumerate(model.langs):
            train = "".join(map(chr, model.symbols(["\n".join(passages[lang])])[0].tolist()))
            test = "".join(map(chr, sym))
            want = sum(plain_phrases(train, test[s:s + L.SEGMENT]) for s in range(0, len(test), L.SEGMENT))
            assert counts[k, j] == want


def test_language_edge_rows(spark):
    rows = [(1, "aaa bbb abab " * 30, "x"), (2, "ccc ddd cdcd " * 30, "y"), (3, None, "x"), (4, "", "y"),
            (5, "123 ... ## ²", "x"), (6, "abab bbb", None), (7, "cdcd \U0001F600 ddd \x00 c", None),
            (None, "abba", None), (6, "abab bbb", None), (8, "ab " * 120_000, None)]
    docs = documents(spark, rows).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(2))
    passages = L.training_passages(docs.withColumn("learn", F.lit(True)))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in L.identify(docs, passages).collect()]
    by = {k: (v, s) for k, v, s in got}
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, _, s in got)
    assert [by[i][0] for i in (1, 2, 3, 4, 5, 6, 7, 8, None)] == ["x", "y", "und", "und", "und", "x", "y", "x", "x"]
    assert {r["lang_pred"] for r in L.identify(docs, {}).collect()} == {"und"}
    assert L.identify(docs.limit(0), passages).count() == 0


@pytest.mark.skipif(not HAVE, reason="driver test data absent")
def test_language_held_out_accuracy(spark):
    got = QUERIES["op10_language_id"](spark, SF01).join(
        spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97


def test_held_out_rows_are_those_of_crc32(spark):
    ids = [0, 1, 17, 99999, -5]
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "doc_id long")
    got = {r["doc_id"]: r["h"] for r in df.select("doc_id", held_out("doc_id", 5, 0).alias("h")).collect()}
    assert got == {**{i: zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}, None: True}


def enumerate_marginals(crf, words):
    """Marginals over all 2^n state sequences."""
    emit = [crf.bias + sum(crf.weights.get(f, 0.0) for f in T.features(w)) for w in words]
    total, out = 0.0, np.zeros(len(words))
    for ys in itertools.product((0, 1), repeat=len(words)):
        s = crf.start * ys[0] + sum(e for e, y in zip(emit, ys, strict=True) if y)
        s += sum(crf.trans[a, b] for a, b in itertools.pairwise(ys))
        total += math.exp(s)
        out += math.exp(s) * np.array(ys)
    return out / total


def test_marginals_equal_enumeration():
    rnd = random.Random(2)
    for _ in range(60):
        crf = T.Crf({"bad$": rnd.uniform(-3, 4), "worse": rnd.uniform(-3, 4)}, rnd.uniform(-4, 1),
                    np.array([[rnd.uniform(-2, 2) for _ in "ab"] for _ in "ab"]), rnd.uniform(-2, 2), (0, 1, 0))
        words = [rnd.choice(["bad", "worse", "worsening", "fine", "ok", "so"]) for _ in range(rnd.randint(1, 9))]
        at, p = crf.marginals(words)
        want = enumerate_marginals(crf, words)
        assert at == [i for i, w in enumerate(words) if w[:5] in ("bad", "worse")]
        assert p == pytest.approx([want[i] for i in at], abs=1e-9)


def test_gradient_of_the_chain():
    rng = np.random.default_rng(0)
    emit, valid = rng.normal(size=(4, 6)), np.ones((4, 6), bool)
    valid[1, 4:] = False
    trans, start = rng.normal(size=(2, 2)), 0.3
    marg, pairs, begin = T._forward_backward(emit, valid, trans, start)
    crf = T.Crf({}, 0.0, trans, start, (0, 0, 0))
    want, both = np.zeros((4, 6)), np.zeros((2, 2))
    for r in range(4):
        n = int(valid[r].sum())
        z = 0.0
        m, b = np.zeros(n), np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=n):
            s = start * ys[0] + sum(emit[r, i] for i in range(n) if ys[i]) + sum(
                crf.trans[a, c] for a, c in itertools.pairwise(ys))
            z += math.exp(s)
            m += math.exp(s) * np.array(ys)
            for a, c in itertools.pairwise(ys):
                b[a, c] += math.exp(s)
        want[r, :n] = m / z
        both += b / z
    assert marg == pytest.approx(want, abs=1e-9)
    assert pairs == pytest.approx(both, abs=1e-9)
    assert begin == pytest.approx(want[:, 0].sum(), abs=1e-9)


def corpus(n=400):
    rnd = random.Random(4)
    plain = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    texts, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) + str(rnd.choice("xyz")) * rnd.randint(0, 1) for _ in range(rnd.randint(5, 60))]
        y = int(i % 4 == 0)
        if y:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), "nasty" + rnd.choice(["", "er", "est", "ish", "ly", "ness", "oid", "um", "y", "zzz"]))
        texts.append(" ".join(words) + f", {i}")
        labels.append(y)
    return texts, labels


def test_learns_spans_from_document_labels():
    texts, labels = corpus()
    crf = T.fit(texts, labels)
    text = "alpha, (Nastyest nastyoo) beta"
    at, p = crf.marginals(T.WORD.findall(text))
    spans = T.spans_of(text, at, p)
    assert [text[s:e] for s, e, _ in spans] == ["Nastyest nastyoo"]
    assert crf.score(p) >= 0.5 > crf.score(crf.marginals(["alpha", "beta"])[1])


def test_toxicity_edge_rows(spark):
    texts, labels = corpus(160)
    rows = list(enumerate(texts))
    docs = documents(spark, [*rows, (900, None), (901, ""), (902, "1 2 ."), (None, "nastyish alpha"), (0, texts[0]),
                             (903, "alpha beta " * 60_000 + "nasty")])
    docs = docs.withColumn("score", F.lit("clash")).withColumn("learn", F.lit(True))
    lab = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(900, None, None), (None, 1, 1), (901, 0, 7)],
                                "doc_id long, quality int, toxic int")
    crf = T.fit_on(docs, lab)
    got = T.score_documents(docs, crf).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + 6 and all(0 <= r["score"] <= 1 for r in got)
    assert [by[i]["predicted"] for i in (900, 901, 902, None, 903)] == [0, 0, 0, 1, 1]
    assert by[903]["spans"][0]["end"] == len("alpha beta " * 60_000) + 5
    assert sum(by[i]["predicted"] != y for i, y in enumerate(labels)) == 0
    clean = T.keep_clean(docs, lab)
    assert clean.columns == docs.columns
    assert clean.where("doc_id is null or doc_id = 903").count() == 0
    assert clean.count() == labels.count(0) + 3
    assert T.keep_clean(docs.limit(0), lab.limit(0)).count() == 0


@pytest.mark.skipif(not HAVE, reason="driver test data absent")
def test_toxicity_held_out(spark):
    lab = spark.read.parquet(f"{SF01}/labels.parquet").select("doc_id", "toxic")
    got = QUERIES["op8_toxicity"](spark, SF01).where("held_out").join(lab, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.93 * len(got)
