import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import HAVE, SF, documents
from pyspark.sql import functions as F

from ledgerscope.llm import alignment as A
from ledgerscope.llm.queries import QUERIES

TOK = A.Tokenizers(*A.default_tokenizers())


def plain_tokens(text):
    """Ids of the whole text with both libraries; None if there are no tokens."""
    if not text:
        return None
    whole = (" " + text).encode()
    a = TOK.a.encode(" " + text, add_special_tokens=False).ids
    b = TOK.b.encode(text)
    if b"".join(TOK.a_bytes[i] for i in a) != whole or b"".join(TOK.b_bytes[i] for i in b) != whole:
        return None
    return a, b


def ends(ids, byte):
    out, at = [], 0
    for i in ids:
        at += len(byte[i])
        out.append(at)
    return out


def plain_rows(rows):
    links, base = [], []
    for _, text in rows:
        got = plain_tokens(text)
        if got is None:
            links.append([])
            base.append((0, 0, 0, ""))
            continue
        (a, b), ea, eb = got, ends(got[0], TOK.a_bytes), ends(got[1], TOK.b_bytes)
        mine = []
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if max(ea[i] - len(TOK.a_bytes[x]), eb[j] - len(TOK.b_bytes[y])) < min(ea[i], eb[j]):
                    mine.append((x, y))
        cuts = sorted(set(ea) & set(eb))
        lo, groups = 0, []
        for c in cuts:
            groups.append(",".join(str(x) for x, e in zip(a, ea, strict=True) if lo < e <= c) + "|"
                          + ",".join(str(x) for x, e in zip(b, eb, strict=True) if lo < e <= c))
            lo = c
        links.append(mine)
        base.append((len(a), len(b), len(groups), ";".join(groups)))
    count = Counter(p for mine in links for p in set(mine))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return sorted([(r[0], x[0], x[1], x[2], len(mine), sum(count[p] == best[p[0]] for p in mine), sum(count[p] for p in mine), x[3])
                   for r, x, mine in zip(rows, base, links, strict=True)], key=str), count


def got(df):
    return sorted([tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"))
                   for r in df.collect()], key=str)


ODD = ["", None, " ", "  ", "\n", "\n\n a", "a\n", "word \n", "two  spaces   three", "a\nb\n\nc", "tab\tand\r\nline", "<|endoftext|> <s> </s> <unk> <0x0A>",
       "a\u2581b", "plain \u2581 mark", "caf\u00e9 \u00e9t\u00e9 na\u00efve \u00ad x", "\u65e5\u672c\u8a9e \u6587\u5b57", "\U0001F600 \u200d smile", "a\u00a0b \u00a0 c",
       "it's we'll 'tis 's", "12345 1,234.5 $9", "\u0645\u0631\u062d\u0628\u0627 \u0628\u0643", "x" * 300, "nul\x00byte", "e\u0301 \u0301e", "\ufeffbom", "\x1c \x1d a\x85b", "A"]


def mixture(seed):
    rnd = random.Random(seed)
    vocab = ["the", "and", "harbour", "Ships,", "na\u00efve", "under_score", "x1", "it's", "\u00fcber", "(so)", "caf\u00e9.", "I", "\u4e2d\u6587"]
    rows = [(i, t) for i, t in enumerate(ODD)]
    for i in range(60):
        seps = rnd.choices([" ", "\n", "  ", " \n", "\n\n", "\t"], [20, 4, 1, 1, 1, 1], k=12)
        rows.append((100 + i, "".join(rnd.choice(vocab) + s for s in seps)))
    return rows + [(100, rows[-1][1]), (100, rows[-1][1]), (None, rows[-2][1]), (None, None)]


def test_documents_equal_whole_text_encoding(spark):
    rows = mixture(3)
    want, count = plain_rows(rows)
    docs = documents(spark, rows).withColumn("groups", F.lit("clash")).withColumn("_keys", F.lit(1)).repartition(3)
    al = A.Alignment(docs)
    assert got(al.documents()) == want
    assert {(r["a"], r["b"]): r["documents"] for r in al.pairs().collect()} == count


def test_slices_and_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_BYTES", 400)
    monkeypatch.setattr(A, "CALL_BYTES", 60)
    monkeypatch.setattr(A, "OUT_BYTES", 300)
    monkeypatch.setattr(A, "SHARD_PAIRS", 16)
    rows = mixture(4)
    al = A.Alignment(documents(spark, rows).repartition(3), pairs_at_once=60)
    assert len(al.slices) > 2
    assert got(al.documents()) == plain_rows(rows)[0]


def test_empty_table_and_no_tokens(spark):
    assert A.Alignment(documents(spark, [])).documents().count() == 0
    al = A.Alignment(documents(spark, [(1, None), (2, "")]))
    assert [r[1:] for r in got(al.documents())] == [(0, 0, 0, 0, 0, 0, "")] * 2 and al.pairs().count() == 0
    assert {r["groups_sha256"] for r in A.alignment_summary(al.documents()).collect()} == {""}


def test_without_the_cutting_property_whole_texts_are_encoded():
    tok = A.Tokenizers(*A.default_tokenizers())
    assert tok.cut
    tok.cut = False
    la, lb = tok.lengths()
    texts = [t for t in ODD if t]
    row = A.encode_block(tok, pa.array(texts))
    block = A.Aligned(row, la, lb)
    want = [plain_tokens(t) for t in texts]
    assert block.per_doc(block.n_a).tolist() == [len(w[0]) if w else 0 for w in want]
    assert block.per_doc(block.n_b).tolist() == [len(w[1]) if w else 0 for w in want]


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 17, 5000):
        keys = np.unique(rng.integers(0, 2**32, n))
        bits = A.build_hash(keys)
        assert sorted(A.slots_of(keys, bits).tolist()) == list(range(len(keys)))


def test_a_missing_pair_is_an_error():
    keys = np.arange(50)
    row = A._build_shard(pa.table({"shard": [0] * 50, "pair": keys})).to_pylist()[0]
    table = A.PairTable([{**row, "counts": None}], 1)
    assert sorted(table.slots(keys).tolist()) == list(range(50))
    with pytest.raises(ValueError):
        table.slots(np.array([7, 10**6]))


@pytest.mark.skipif(not HAVE, reason="no test data")
def test_whole_table(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = {r["doc_id"]: r for r in QUERIES["op11_token_alignment"](spark, SF).collect()}
    assert len(out) == len(rows)
    for k, text in rows:
        a, b = plain_tokens(text) or ([], [])
        ea, eb = ends(a, TOK.a_bytes), ends(b, TOK.b_bytes)
        assert (out[k]["n_a"], out[k]["n_b"], out[k]["n_groups"]) == (len(a), len(b), len(set(ea) & set(eb)))
        # two rows of intervals that cover the same bytes: each cut starts one link, each end inside starts another
        assert out[k]["n_links"] == len(set(ea) | set(eb))
    some = [r for r in rows if r[1] and len(r[1]) < 300][:5]
    for (k, _), want in zip(sorted(some, key=str), [r for r in plain_rows(some)[0]], strict=True):
        assert out[k]["groups_sha256"] == hashlib.sha256(want[7].encode()).hexdigest()


def test_a_written_block_is_a_row_group_and_links_are_counted_in_parts(spark, monkeypatch):
    """Neither a file of blocks nor a block's links are held at once."""
    import pyarrow.parquet as pq
    rows = mixture(5)
    monkeypatch.setattr(A, "BLOCK_BYTES", 400)
    monkeypatch.setattr(A, "LINKS_AT_ONCE", 7)
    al = A.Alignment(documents(spark, rows).coalesce(1))
    files = [pq.ParquetFile(p.removeprefix("file://")).metadata for p in al.blocks.inputFiles()]
    groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert len(groups) > 2 and set(groups) == {1}
    assert {(r["a"], r["b"]): r["documents"] for r in al.pairs().collect()} == plain_rows(rows)[1]
    block = A.Aligned(A.encode_block(TOK, pa.array([t for _, t in rows], pa.string())), *TOK.lengths())
    distinct, slots = np.unique(block.pairs, return_inverse=True)
    total = np.zeros(len(distinct), np.uint32)
    block.add_pairs_of_docs(slots, total)
    assert dict(zip([divmod(int(p), 1 << 16) for p in distinct], total.tolist(), strict=True)) == plain_rows(rows)[1]
