import math
import random
import re
from collections import Counter

import pytest
from helpers import HAVE, SF, documents, same_as_sql
from pyspark.sql import functions as F

from ledgerscope.llm import quality as Q
from ledgerscope.llm import url_filter as U
from ledgerscope.llm.queries import ORACLE, QUERIES

URLS = [None, "", "no scheme", "http://", "http://A.com", "http://a.com/", "http://com/x",
        "https://www.Example.com/en/1?utm_source=a&b=2&a=1#f", "http://example.com/en/1?a=1&b=2",
        "http://m.example.com/en", "http://x.net/es/1", "http://x.net/fr/", "http://net/fr/é",
        "http://notnet/es/", "http://h.org:80/p/", "http://h.org/p", "http://h.org/p?ref=1",
        "http://h.org?x=://y/z", "ftp://ÄB.org/x\ny#q"]


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_hosts_rules_and_lists(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(15, URLS[15], "again")],
                                  "page_id long, url string, listed string")
    listed = spark.createDataFrame([("h.org/p",), ("h.org/p",), (None,)], "canonical string")
    got = U.judge(pages, listed).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        u = URLS[r["page_id"]]
        host, path = plain_host_path(u)
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        hit = u in ("http://h.org:80/p/", "http://h.org/p", "http://h.org/p?ref=1")
        assert r["listed"] == hit
        assert r["verdict"] == (verdict or ("block" if hit else "allow"))
    same = {r["canonical"] for r in got if r["page_id"] in (7, 8)}
    assert same == {"example.com/en/1?a=1&b=2"}


def test_bloom_filter_misses_nothing_and_the_join_removes_false_hits(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"))
    listed = keys.where("crc32(k) % 4 = 0")
    n = listed.count()
    blocks = U.bloom_blocks(listed, "k", 4)                 # far too small: many false hits
    for limit in (32 << 20, 0):                             # broadcast and shuffled blocks
        maybe = U.possible_hits(keys, "k", blocks, 4, broadcast_bytes=limit)
        assert maybe.join(listed, "k", "left_semi").count() == n
        assert maybe.count() > n
    assert U.listed_keys(keys, "k", listed, "k", bits_per_key=2).count() == n
    assert U.listed_keys(keys, "k", listed.limit(0), "k").count() == 0
    wide = U.possible_hits(keys, "k", U.bloom_blocks(listed, "k", math.ceil(n / 32)), math.ceil(n / 32))
    assert wide.count() < n * 1.05


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def test_base_counts_against_plain_loops(spark):
    rnd = random.Random(3)
    texts = ["", None, " ", "a", "a b", "a b c a b c", "\n\n", "x\nx\nx \nx", "é ü 𝒳 \x1f",
             "a a a a a", "#*$%&|<>", "w " * 70 + "end"]
    texts += [" ".join(rnd.choice("abcd|") + rnd.choice(["", "\n", "\t"]) for _ in range(rnd.randint(0, 90)))
              for _ in range(60)]
    texts.append(" ".join(str(rnd.randint(0, 3000)) for _ in range(60_000)))
    got = Q.base_metrics(documents(spark, list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in Q.BASE) == plain_counts(texts[r["doc_id"]] or "")


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 5, 17, 400, 5000) for k in (0, 1, 3, 40) if k <= n]
    df = spark.createDataFrame(cases, "n long, k long")
    for p in (0.01, 0.2):
        for r in df.withColumn("t", Q.binomial_tail(F.col("n"), F.col("k"), p)).collect():
            exact = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1)
                                 + i * math.log(p) + (r.n - i) * math.log1p(-p)) for i in range(r.k + 1))
            assert r["t"] == pytest.approx(1.0 if r.k > r.n * p else exact, rel=1e-8)


def test_cutoffs_need_labels_and_spare_good_documents(spark):
    """Good documents have few symbols, bad ones many; the certified cutoff separates them, and
    its false rejections stay below the limit.  Too few labels certify nothing."""
    def rows(n):
        out = []
        for i in range(n):
            for stratum in ("en", "other"):
                out.append((stratum, True, (i % 100) / 400.0, 0.0, 0.0, 5.0, -5.0))
                out.append((stratum, False, 0.55 + (i % 10) / 10, 0.0, 0.0, 5.0, -5.0))
        return out

    cols = "stratum string, good boolean, " + ", ".join(f"{r} double" for r in Q.LADDERS)
    many = Q.choose_cutoffs(Q.ladder_counts(spark.createDataFrame(rows(2000), cols))).collect()
    assert {(r["stratum"], r["rule"]) for r in many} == {("en", "symbol_ratio"), ("other", "symbol_ratio")}
    assert all(0.25 <= r["cutoff"] <= 0.5 and r["p_value"] <= 0.05 / 25 for r in many)
    few = Q.choose_cutoffs(Q.ladder_counts(spark.createDataFrame(rows(100), cols)))
    assert few.count() == 0
    assert Q.choose_cutoffs(Q.ladder_counts(spark.createDataFrame([], cols))).count() == 0


def test_false_rejections_stay_below_alpha_on_fresh_documents(spark):
    """Simulated labels without any signal: whatever is chosen rejects at most alpha of fresh ones."""
    rnd = random.Random(8)

    def draw(n):
        return [("en", rnd.random() < 0.8, abs(rnd.gauss(0, 0.5)), rnd.random() ** 4, rnd.random() ** 6,
                 rnd.gauss(6, 3), -rnd.gauss(6, 1.5)) for _ in range(n)]

    cols = "stratum string, good boolean, " + ", ".join(f"{r} double" for r in Q.LADDERS)
    chosen = Q.choose_cutoffs(Q.ladder_counts(spark.createDataFrame(draw(6000), cols)), cost=0.0).collect()
    cut = {r["rule"]: r["cutoff"] for r in chosen}
    fresh = [r for r in draw(20_000) if r[1]]
    bad = sum(any(v > cut.get(rule, math.inf) for rule, v in zip(Q.LADDERS, r[2:], strict=True)) for r in fresh)
    assert bad <= 0.06 * len(fresh)


def test_quality_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = documents(spark, [(1, text, "en"), (1, text, "en"), (2, None, None), (None, text, "xx"), (3, "a", "de")])
    docs = docs.withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(9))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 0, 0), (3, None, 1)],
                                   "doc_id long, quality int, toxic int")
    got = Counter((r["doc_id"], r["base_failed"], r["kept"]) for r in Q.quality_rules(docs, labels).collect())
    assert got == {(1, False, True): 2, (2, True, False): 1, (None, False, True): 1, (3, True, False): 1}
    good = Q.keep_good(docs, labels)
    assert good.columns == docs.columns and good.count() == 3
    assert Q.keep_good(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.skipif(not HAVE, reason="driver test data absent")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    same_as_sql(QUERIES[name](spark, SF), ORACLE[name])
