import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import HAVE, SF, documents
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerscope.llm import bagminhash as B
from ledgerscope.llm import merkle as M
from ledgerscope.llm import mixing as X
from ledgerscope.llm import neardup as N


# ------------------------------------------------------------------ Merkle trees
def test_fingerprints_of_edge_rows(spark):
    rows = [(2, None), (3, ""), (5, "One. Two.\n\nThree"), (5, "One. Two.\n\nThree"), (9, "x"), (None, "One. Two.\n\nThree"),
            (7, "word " * 100_000)]
    docs = documents(spark, rows).withColumn("fingerprint", F.lit("clash"))
    got = M.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] != by[9]["fingerprint"]
    assert by[5]["fingerprint"] == by[None]["fingerprint"]
    assert by[2]["near_next"] == 1.0 and by[9]["n_chars"] == 1 and by[9]["near_edited"] == 1.0
    assert by[7]["near_edited"] >= 0.5 and by[7]["n_chars"] == 500_000
    one = M.edited_fingerprints(documents(spark, [(1, "Only one. Here it is. Again and again. So.")])).first()
    assert one["near_next"] == 1.0
    assert M.edited_fingerprints(docs.limit(0)).count() == 0


def test_next_documents_wrap_around(spark):
    ids = [4, 1, 9, 7, 30, 12]
    docs = documents(spark, [(i, "t" * i) for i in ids]).repartition(4)
    got = {r["id"]: (r["prev"], r["prev_n"]) for r in M.following(docs).collect()}
    order = sorted(ids)
    assert got == {i: (f"i{p}", p) for i, p in zip(order, [order[-1], *order[:-1]], strict=True)}


def test_edits_are_located(spark):
    old = documents(spark, [(1, "a\nb\n\nc\nd"), (2, "same\n\nsame")])
    new = documents(spark, [(1, "a\nb\n\nc\nD\ne"), (2, "same\n\nsame")])
    got = {(r["doc_id"], r["level"], r["section"], r["paragraph"]) for r in M.locate_edits(old, new).collect()}
    assert got == {(1, 0, None, None), (1, 1, 1, None), (1, 2, 1, 1), (1, 2, 1, 2)}
    assert M.locate_edits(old, old).count() == 0


def test_white_space_between_sections_counts(spark):
    docs = documents(spark, [(1, "a\n\nb"), (2, "a\n\n\nb"), (3, "a\n \nb")])
    roots = [r[0] for r in docs.select(M.root(F.col("text"))).collect()]
    assert len(set(roots)) == 3


# ------------------------------------------------------------------ mixing
def plain_schedule(quota, period):
    served, out = dict.fromkeys(quota, 0), []
    for t in range(period):
        ready = [(-(-(served[s] + 1) * period // q), s) for s, q in sorted(quota.items())
                 if served[s] * period // q <= t]
        s = min(ready)[1]
        served[s] += 1
        out.append((s, served[s]))
    return out


@pytest.mark.parametrize("quota", [{"sa": 1}, {"sa": 500, "sb": 300, "sc": 199, "sd": 1}, {"sa": 333, "sb": 333, "sc": 334},
                                   {f"s{i:02d}": q for i, q in enumerate([310, 1, 2, 3, 50, 50, 84, 100, 100, 300])}])
def test_pfair_schedule(spark, quota):
    period = sum(quota.values())
    df = spark.createDataFrame([(s, i + 1, q) for i, (s, q) in enumerate(sorted(quota.items()))], "src string, idx int, q long")
    got = [(r["src"], r["j"]) for r in X.schedule(df, period).orderBy("slot").collect()]
    assert got == plain_schedule(quota, period)
    served = Counter()
    for t, (s, _) in enumerate(got, 1):
        served[s] += 1
        for k, q in quota.items():
            assert abs(served[k] - t * q / period) < 1


def test_quotas_keep_to_the_weights(spark):
    totals = spark.createDataFrame([("sa", 10**6), ("sb", 10**5), ("sc", 10), ("n", 1)], "src string, total long")
    for temp in (1.0, 0.5, 0.0):
        got = {r["src"]: r["q"] for r in X.quotas(totals, 1000, temp, None).collect()}
        w = {r["src"]: r["total"] ** temp for r in totals.collect()}
        assert sum(got.values()) == 1000
        assert all(abs(got[s] - 1 - 996 * w[s] / sum(w.values())) < 1 for s in got)
    given = spark.createDataFrame([("a", 3.0), ("b", 1.0), (None, 0.0)], "source string, weight double")
    got = {r["src"]: r["q"] for r in X.quotas(totals, 1000, 1.0, given).collect()}
    assert got == {"sa": 750, "sb": 250} or abs(got["sa"] - 750) <= 1


def mixture(spark):
    rnd = random.Random(6)
    rows = [(i, "x" * rnd.randint(0, 300), "en", rnd.choice(["hot"] * 6 + ["b", "c", None])) for i in range(400)]
    rows += [rows[0], rows[0], (None, None, None, "b"), (1, "long " * 4000, "en", "c")]
    return documents(spark, rows), rows


def test_every_document_once_per_epoch_and_blocks_in_their_windows(spark):
    docs, rows = mixture(spark)
    got = X.mix(docs.withColumn("slot", F.lit("clash")), block_chars=500, temperature=0.6).collect()
    first = Counter()
    for r in got:
        assert r["release"] <= r["slot"] < r["deadline"]
        if r["epoch"] == 1:
            first[(r["doc_id"], r["source"])] += r["copies"]
    assert first == Counter((r[0], r[3]) for r in rows)
    epochs = defaultdict(set)
    for r in got:
        epochs[r["source"]].add(r["epoch"])
    assert epochs["hot"] == {1} and max(max(e) for e in epochs.values()) <= X.MAX_EPOCHS
    assert max(len(e) for e in epochs.values()) > 1
    # one source per slot
    assert all(len(s) == 1 for s in _by(got, "slot", "source").values())
    out = X.mixed_documents(docs, block_chars=500, temperature=0.6)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert X.mixed_documents(docs.limit(0)).count() == 0


def _by(rows, key, value):
    out = defaultdict(set)
    for r in rows:
        out[r[key]].add(r[value])
    return out


# ------------------------------------------------------------------ near-duplicates
def test_signatures_are_unbiased_and_consistent():
    rng = np.random.default_rng(3)
    diff = []
    for _ in range(80):
        ids = rng.integers(0, 2**52, 150).astype(np.uint64)
        wa = rng.integers(0, 12, 150)
        wb = np.where(rng.random(150) < 0.5, wa, rng.integers(0, 12, 150))
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        a, b = wa > 0, wb > 0
        sig = B.signatures(np.r_[np.zeros(a.sum(), int), np.ones(b.sum(), int)], np.r_[ids[a], ids[b]],
                           np.r_[wa[a], wb[b]], 2, 512)
        alone = B.signatures(np.zeros(b.sum(), int), ids[b][::-1].copy(), wb[b][::-1].copy(), 1, 512)
        assert (alone[0] == sig[1]).all()
        diff.append(B.similarity(sig[0], sig[1]) - want)
    assert abs(np.mean(diff)) < 4 * np.std(diff) / len(diff) ** 0.5
    assert np.std(diff) < 0.03


def test_intervals_cover_the_weight():
    w = np.arange(1, 200)
    e, k = B.intervals(w)
    for i, x in enumerate(w):
        lows = [0 if j == 0 else 2 ** (j - 1) for j in k[e == i]]
        assert lows == [0] + [2**j for j in range(20) if 2**j < x]


def plain_multiset(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def plain_classes(rows, threshold=0.8):
    """{position: smallest doc_id of the class} by all pairs."""
    sets, parent = [plain_multiset(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            size = sum(sets[i].values()) + sum(sets[j].values()) - both
            if (rows[i][1] or "") == (rows[j][1] or "") or size and both / size >= threshold:
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        if k is not None:
            low[r] = min(low.get(r, k), k)
    return [(k, low.get(find(i))) for i, (k, _) in enumerate(rows)]


def planted():
    rnd = random.Random(7)
    vocab = ["w%d" % i for i in range(500)]
    base = [rnd.choices(vocab, k=rnd.choice([12, 60, 200])) for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(rnd.choice([1, 2, 6])):
            w = list(b)
            for _ in range(rnd.choice([0, 0, 1, 2, 8])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append(" ".join(w))
    hot = rnd.choices(vocab, k=120)
    for _ in range(60):                                     # a hot group of near copies of one text
        w = list(hot)
        for _ in range(rnd.choice([0, 1, 2, 3, 6])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append(" ".join(w))
    rows += ["Same Words, here now too", "same words here NOW too!"] + ["one two", "one two", "two one"] + [None, "", "  ", "...", "..."]
    out = list(enumerate(rows)) + [(3, rows[3]), (None, rows[5]), (None, "all alone in this class here")]
    rnd.shuffle(out)
    return out


def test_classes_equal_all_pairs(spark):
    rows = planted()
    docs = documents(spark, rows).withColumn("node", F.lit("clash")).repartition(3)
    got = Counter((r["doc_id"], r["class_id"]) for r in N.near_duplicates(docs).collect())
    assert got == Counter(plain_classes(rows))
    kept = N.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    classes = plain_classes(rows)
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in classes if c is not None})
    assert ids.count(None) == 1                             # the class without any id


def test_classes_are_kept_apart_by_more_than_their_id(spark):
    """Unrelated texts with one id are two documents; near copies without ids are one."""
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(["first", *words[1:]])]
    rows = [(7, "an unrelated text about harbours and ships"), (7, "quite another text on bread and ovens"),
            (9, "quite another text on bread and ovens"), *[(None, t) for t in near], (None, near[0])]
    docs = documents(spark, rows).repartition(3)
    found = N.near_duplicates(docs).collect()
    assert len(found) == len(rows) and len({r["label"] for r in found}) == 3
    kept = [(r["doc_id"], r["text"]) for r in N.keep_first(docs).collect()]
    assert sorted(t for k, t in kept if k == 7) == [rows[0][1], rows[1][1]]
    assert len(kept) == 3 and [k for k, _ in kept].count(None) == 1


def test_thresholds_below_the_bands_are_refused(spark):
    with pytest.raises(ValueError, match="threshold"):
        N.near_duplicates(documents(spark, [(1, "a")]), threshold=0.5)


def test_near_duplicates_of_small_tables(spark):
    assert N.near_duplicates(documents(spark, [])).count() == 0
    assert N.keep_first(documents(spark, [])).count() == 0
    long = " ".join(f"a{i % 50_000}" for i in range(120_000))
    got = N.near_duplicates(documents(spark, [(2, long), (1, long + " tail"), (3, "b")])).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == [(1, 1), (2, 1), (3, 3)]


def test_components_of_a_long_chain(spark):
    n = 90
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201), (300, 300)], "a long, b long")
    got = {r["node"]: r["label"] for r in N.components(edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 200: 200, 201: 200, 300: 300}


# ------------------------------------------------------------------ pipeline
@pytest.mark.skipif(not HAVE, reason="driver test data absent")
def test_pipeline_stages_against_plain_versions(spark):
    from helpers import duck

    from ledgerscope.llm import packing, toxicity
    from ledgerscope.llm.oracle_sql import QUALITY

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "toxicity", "near_duplicates", "mixture", "packing"]

    good = stage["quality"](spark, docs, SF).cache()
    want = {r[0] for r in duck().sql(f"SELECT doc_id FROM ({QUALITY}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in good.collect()} == want and good.columns == docs.columns

    clean = stage["toxicity"](spark, good, SF).cache()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    known = [(t, labels[k]) for k, t in rows if k in labels]
    crf = toxicity.fit([t for t, _ in known], [y for _, y in known])
    plain = {k for k, t in rows if crf.score(crf.marginals(toxicity.WORD.findall(t))[1]) < 0.5}
    assert {r["doc_id"] for r in clean.collect()} == plain

    first = stage["near_duplicates"](spark, clean, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert {r["doc_id"] for r in first.collect()} == {c for _, c in plain_classes(rows)}

    mixed = stage["mixture"](spark, first, SF).cache()
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in first.collect()}

    pieces = stage["packing"](spark, mixed, SF).collect()
    enc = packing.encoder(packing.default_tokenizer())
    total = sum(len(i) for i in enc.encode([r["text"] for r in mixed.collect()], 2))
    assert sum(r["length"] for r in pieces) == total
    for df in (good, clean, first, mixed):
        df.unpersist()


def test_packing_keeps_the_order_of_the_mixture(spark, tmp_path):
    """Later files are longer, so reading them alone would turn their order around."""
    rows = [(i, f"text {i} " + "more words here. " * (20 * (i // 100) ** 2)) for i in range(600)]
    docs = documents(spark, rows).repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id")
    docs.write.parquet(f"{tmp_path}/mixture")
    back = spark.read.parquet(f"{tmp_path}/mixture")
    assert len(back.inputFiles()) > 3
    pieces = dict(corpus_pipeline.STAGES)["packing"](spark, back, "").collect()
    starts = sorted((r["sequence_id"], r["offset"], r["doc_id"]) for r in pieces if r["start"] == 0)
    assert [k for _, _, k in starts] == list(range(600))


def test_packing_leaves_other_tables_in_their_order(spark, tmp_path):
    """The files' order counts only where the rows come from the files as they are."""
    documents(spark, [(i, f"text {i}.") for i in range(60)]).coalesce(1).write.parquet(f"{tmp_path}/d")
    turned = spark.read.parquet(f"{tmp_path}/d").repartitionByRange(3, F.col("doc_id").desc())
    turned = turned.sortWithinPartitions(F.col("doc_id").desc())
    pieces = dict(corpus_pipeline.STAGES)["packing"](spark, turned, "").collect()
    starts = sorted((r["sequence_id"], r["offset"], r["doc_id"]) for r in pieces if r["start"] == 0)
    assert [k for _, _, k in starts] == list(range(59, -1, -1))


@pytest.mark.skipif(not HAVE, reason="driver test data absent")
def test_pipeline_runs_as_one_query(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0


def test_clashing_columns_pass_through(spark):
    docs, rows = mixture(spark)
    names = ["_id", "_t", "_h", "_slot", "_source", "_row", "_node", "_doc", "_written", "node", "label", "class_id"]
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    out = X.mixed_documents(docs, block_chars=500, temperature=0.6)
    assert out.columns == docs.columns
    assert all(r[n] is None or r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in names)
    kept = N.keep_first(docs)
    assert kept.columns == docs.columns and all(r[n] is None or r[n] == f"{n}{r['doc_id']}" for r in kept.collect() for n in names)


def test_a_filter_doesnt_lose_the_files_order(spark, tmp_path):
    docs = documents(spark, [(i, "t" * (1 + i % 7 * 900)) for i in range(200)]).withColumn("_written", F.lit("clash"))
    docs.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/d")
    for rows in (spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/d").where("doc_id % 3 = 0").select("doc_id", "_written")):
        back = corpus_pipeline.in_file_order(rows)
        ids = [r["doc_id"] for r in back.collect()]
        assert back.columns == rows.columns and ids == sorted(ids) and len(ids) > 60
        assert back.first()["_written"] == "clash"


def true_pairs(rows, threshold=0.8):
    """(positions of) all pairs of texts at or above the threshold, through their shared shingles."""
    sets, seen = [plain_multiset(t) for _, t in rows], defaultdict(list)
    for i, m in enumerate(sets):
        for k in m:
            seen[k].append(i)
    near = {(i, j) for at in seen.values() for n, j in enumerate(at) for i in at[:n]}
    out = []
    for i, j in near:
        both = sum((sets[i] & sets[j]).values())
        if both >= threshold * (sum(sets[i].values()) + sum(sets[j].values()) - both):
            out.append((i, j))
    return out


@pytest.mark.skipif(not HAVE, reason="no test data")
def test_recall_of_a_whole_table(spark):
    """Every pair of documents at 0.8 or more lies in one class (at least 0.9 is asked for)."""
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["doc_id"]: r["label"] for r in N.near_duplicates(documents(spark, rows)).collect()}
    pairs = true_pairs(rows)
    hits = sum(found[rows[i][0]] == found[rows[j][0]] for i, j in pairs)
    assert len(pairs) >= 10 and hits >= 0.9 * len(pairs)
