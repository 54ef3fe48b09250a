import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import HAVE, SF, documents, duck, same_as_sql
from pyspark.sql import functions as F

from ledgerscope.llm import oracle_sql as SQL
from ledgerscope.llm import substrings as S
from ledgerscope.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window):
    docs = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(rows, docs, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        spans, prev = [], None
        for j in sorted(gone):
            if prev != j - 1:
                spans.append([j, 0])
            spans[-1][1] += 1
            prev = j
        out.append((k, len(w), [tuple(s) for s in spans], " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted([(r[0], r["n_words"], [tuple(s) for s in r["removed"]], r["kept"]) for r in df.collect()], key=str)


def planted(rnd):
    vocab = [f"w{i}" for i in range(400)] + ["né", "x\x1cy"]
    passages = [rnd.choices(vocab, k=rnd.choice([34, 35, 36, 60, 150])) for _ in range(8)]
    hot = rnd.choices(vocab, k=50)
    rows = []
    for i in range(120):
        w = rnd.choices(vocab, k=rnd.randint(0, 80))
        if i % 3 == 0:
            w += hot                                        # in a third of all documents
        if rnd.random() < 0.5:
            p = list(rnd.choice(passages))
            if rnd.random() < 0.3:
                p[rnd.randrange(len(p))] = "changed"
            w += p + rnd.choices(vocab, k=rnd.randint(0, 40))
        if rnd.random() < 0.1:
            w += w
        rows.append((i, rnd.choice([" ", "\n", "\t ", "  "]).join(w)))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "a " * 34), (904, "a " * 35), (905, "a " * 36), (905, "b " * 36),
             rows[0], rows[0], (None, rows[3][1]), (None, " ".join(vocab))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("window,first,block", [(35, 9, 4_000_000), (35, 9, 3_000), (5, 2, 3_000), (1, 9, 4_000_000), (36, 40, 9_000)])
def test_removals_equal_a_plain_count(spark, monkeypatch, window, first, block):
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    rows = planted(random.Random(window))
    docs = documents(spark, rows).withColumn("removed", F.lit("clash")).withColumn("_block", F.lit(1)).repartition(3)
    assert got(S.repeated_passages(docs, window=window, first=first)) == plain(rows, window)


def test_no_rows_and_no_repeats(spark):
    assert S.repeated_passages(documents(spark, [])).count() == 0
    rows = [(1, " ".join(f"a{i}" for i in range(100))), (2, " ".join(f"b{i}" for i in range(100)))]
    assert got(S.repeated_passages(documents(spark, rows))) == plain(rows, 35)


def test_levels_double_up_to_the_window():
    assert S.levels(35, 9) == [9, 18, 35] and S.levels(8, 9) == [8] and S.chain(35)[0] == 1
    for window in range(1, 80):
        c = S.chain(window)
        assert all(a < b <= 2 * a for a, b in zip(c, c[1:]))


def test_what_stands_for_a_window_depends_on_its_words_only():
    rnd = random.Random(1)
    passage = [rnd.choice("abc") for _ in range(60)]
    block = S.Block(pa.array([" ".join(["x"] * 7 + passage + ["y"] * 5), " ".join(["z"] * 50 + passage)]), 35, 9, 8)
    at = {int(a): int(s - a) for a, s in zip(block.at, block.stand, strict=True)}
    for i in range(60 - 35 + 1):
        assert at[7 + i] == at[72 + 50 + i]
    v = np.array(rnd.choices(range(5), k=200), np.uint64)
    least = S.least_in_windows(v, 27)
    assert least.tolist() == [i + int(np.argmin(v[i:i + 27])) for i in range(200 - 26)]


@pytest.mark.skipif(not HAVE, reason="no test data")
def test_whole_table_against_sql(spark):
    same_as_sql(QUERIES["op12_substring_dedup"](spark, SF), SQL.SUBSTRINGS, duck())
