import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import HAVE, SF, documents
from pyspark.sql import functions as F

from ledgerscope.llm import runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, times=4, least=6):
    """(start, length, period) by comparing all words of all periods."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)      # the smallest comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def echoed(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain_row(doc_id, text):
    w = echoed(doc_id, text)
    runs = plain_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, len(runs), s, n, q, n and 1000 * n // q,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def rows_of(df):
    return sorted([(r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"],
                    r["runs_sha256"], r["collapsed_sha256"]) for r in df.collect()], key=str)


def test_runs_equal_all_comparisons():
    rnd = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            w = []
            while len(w) < rnd.randint(0, 60):
                p = [rnd.randint(0, rnd.choice([1, 2, 5])) for _ in range(rnd.randint(1, 7))]
                w += (p * rnd.choice([1, 1, 3, 4, 5, 9]))[:rnd.randint(1, 40)]
            texts.append(w)
        codes = np.array([x for w in texts for x in w], np.int64)
        lo, hi, d = R.find_runs(codes, np.cumsum([len(w) for w in texts]))
        want, base = [], 0
        for w in texts:
            want += [(base + s, base + s + n, q) for s, n, q in plain_runs(w)]
            base += len(w)
        assert list(zip(lo.tolist(), hi.tolist(), d.tolist(), strict=True)) == want


def test_edge_rows(spark):
    texts = ["", None, " \t\n", "a", "a a a a a", "a a a a a a", "x " + "a b " * 4 + "c", "a\x0bb\x1cb a a",
             "word " * 1500, "né à " * 30 + "z", " ".join(map(str, range(300))), ("one two three " * 9 + "\n") * 3]
    rows = [(i, t) for i, t in enumerate(texts * 8)] + [(3, texts[5]), (3, texts[5]), (None, texts[6]), (None, texts[6])]
    docs = documents(spark, rows).withColumn("runs", F.lit("clash")).withColumn("_text", F.lit(1)).repartition(3)
    got = rows_of(R.run_summary(R.periodic_runs(R.echo_tails(docs))))
    assert got == sorted([plain_row(*r) for r in rows], key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts) * 8))
    assert R.periodic_runs(docs.limit(0)).count() == 0


def test_collapsed_text_is_real(spark):
    got = R.periodic_runs(documents(spark, [(1, "so " + "la di " * 5 + "end")])).first()
    assert [tuple(r) for r in got["runs"]] == [(1, 10, 2)] and got["collapsed"] == "so la di end"
    with pytest.raises(ValueError):
        R.periodic_runs(documents(spark, []), times=2)


@pytest.mark.skipif(not HAVE, reason="no test data")
def test_whole_table(spark):
    from ledgerscope.llm.queries import QUERIES
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    small = [r for r in docs if len(r[1] or "") < 2500]
    want = {r[0]: r for r in (plain_row(*r) for r in small)}
    got = {r[0]: r for r in rows_of(QUERIES["op13_periodic_runs"](spark, SF))}
    assert len(got) == len(docs) and all(got[k] == v for k, v in want.items())
    assert sum(r[1] > 0 for r in got.values()) > len(docs) // 12
