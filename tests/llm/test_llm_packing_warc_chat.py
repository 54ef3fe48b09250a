import random
import zlib

import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F

from ledgerscope.llm import chat as C
from ledgerscope.llm import packing as P
from ledgerscope.llm import warc as W
from ledgerscope.llm.common import shared_folder

ODD = ["", " ", "A<|endoftext|>b <|startoftext|>", "it's don't I'LL we'Ve 'S", "\x1c\x1d x\x85y \x00", "ΣΑΣ İx ²3 １ é é",
       "a_b __ 12 ½ ª\xad", "x" * 300, "ß" * 70, " q　r", "Don't.STOP!?.. no", "é" * 33 + ".", "𝒳 \U0001F600"]


def test_ids_equal_the_tokenizer():
    enc = P.Encoder(P.default_tokenizer())
    rnd = random.Random(1)
    letters = "abcdeéèüñß'.,!? \n-_0123456789AZ"
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 200))) for _ in range(400)]
    for k in range(0, len(texts), 50):                       # the caches overflow on the way
        for t, ids in zip(texts[k:k + 50], enc.encode(texts[k:k + 50], 2), strict=True):
            assert ids.tolist() == [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 2], t


def test_cuts_are_the_cheapest():
    rnd = random.Random(2)
    for _ in range(40):
        limit = 64
        pos = np.cumsum([rnd.randint(1, 40) for _ in range(60)]).tolist()
        pen = [rnd.choice([0.0, 4.0, 30.0]) for _ in pos]
        cost, back = P.best_cuts(pos, pen, limit)
        plain = []
        for i, p in enumerate(pos):
            before = [(0.0, 0)] + [(plain[j], pos[j]) for j in range(i)]
            plain.append(min(c + pen[i] + limit - (p - q) for c, q in before if p - q <= limit))
        assert cost == pytest.approx(plain)
        assert all((pos[i] - (pos[back[i]] if back[i] >= 0 else 0)) <= limit for i in range(len(pos)))


def check_pieces(rows, want_ids):
    """Every id of every document is in one piece; sequences are gapless and within the limit."""
    seqs, docs = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append((r["start"], ids.tolist(), r["doc_tokens"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    for k, ids in want_ids.items():
        parts = sorted(docs.pop(k))
        assert sum((p[1] for p in parts), []) == ids and {p[2] for p in parts} == {len(ids)}
    assert not docs
    return {s: sum(n for _, n in p) for s, p in seqs.items()}


def test_packs_whole_documents(spark):
    rnd = random.Random(3)
    words = ["the", "of", "inge", "ation.", "xq", "zz!"]
    texts = {i: " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 200, 900]))) for i in range(120)}
    texts[500] = " ".join("q" for _ in range(20_000))       # no sentence end
    texts[501] = " ".join("Sentence number one ends here." for _ in range(60_000))
    texts[502], texts[503] = ODD[3], None
    docs = documents(spark, list(texts.items())).withColumn("start", F.lit("clash")).coalesce(2)
    enc = P.encoder(P.default_tokenizer())
    want = {k: [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for k, t in texts.items()}
    sizes = check_pieces(P.pack(docs).collect(), want)
    total = sum(sizes.values())
    padding = sum(4096 - n for n in sizes.values() if n & (n - 1))
    assert padding < 0.02 * total
    assert P.pack(docs.limit(0)).count() == 0


def test_packs_repeated_rows_and_null_keys(spark):
    docs = documents(spark, [(1, "a b."), (1, "a b."), (None, "c"), (None, None)])
    rows = P.pack(docs).collect()
    assert sorted((r["doc_id"] or 0, r["length"], r["start"]) for r in rows) == [(0, 1, 0), (0, 2, 0), (1, 4, 0), (1, 4, 0)]
    r = next(r for r in P.pack(docs).withColumn("c", F.crc32("ids")).collect() if r["doc_id"] == 1)
    assert r["c"] == zlib.crc32(r["ids"])


# ------------------------------------------------------------------ WARC
PAGES = "page_id long, url string, html string"


def pages(spark):
    big, other = "b" * 1200, "é" * 700
    rows = [(1, "http://a/%0d\r\nX: y", big), (2, "http://b", big), (3, None, big), (4, "u", "small"), (5, "u", "small"),
            (6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", other + "\r\n\r\nWARC/1.1"), (None, "u", other),
            (3, None, big), (10, "u", "x" * 999), (11, "u", "x" * 999), (12, "u é", "y" * 300_000)]
    return spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")), rows


def test_warc_round_trip(spark):
    df, rows = pages(spark)
    got = W.write_and_read(df, with_payload=True, roll_bytes=2000, shards=3).collect()
    assert len(got) == len(rows)
    kinds = {}
    for r in got:
        kinds.setdefault(r["key"], set()).add((r["record_type"], r["refers_to"]))
    assert kinds == {1: {("revisit", 3)}, 2: {("revisit", 3)}, 3: {("response", None)}, 4: {("response", None)},
                     5: {("response", None)}, 6: {("response", None)}, 7: {("response", None)}, 8: {("response", None)},
                     9: {("response", None)}, None: {("revisit", 8)}, 10: {("response", None)},
                     11: {("response", None)}, 12: {("response", None)}}
    by = {k: (u, h) for k, u, h in rows}
    for r in got:
        url, html = by[r["key"]]
        assert r["url"] == url and r["payload_bytes"] == len((html or "").encode())
        assert r["payload"] == (b"" if r["record_type"] == "revisit" else (html or "").encode())


def test_warc_files_are_deterministic_and_survive_leftovers(spark):
    df, rows = pages(spark)
    a, b = shared_folder(spark, "wa"), shared_folder(spark, "wb")
    first = W.write_warc(df, a, shards=2, roll_bytes=1500).orderBy("path").collect()
    again = W.write_warc(df.repartition(5), b, shards=2, roll_bytes=1500).orderBy("path").collect()
    assert first == again and sum(r["n_records"] for r in first) == len(rows)
    fs, path = W.file_system(a)
    with fs.open_output_stream(f"{path}/.part-000009-00000.warc.gz.77.tmp", compression=None) as f:
        f.write(b"half a file of a lost attempt")
    assert W.read_warc(spark, a).count() == len(rows)
    with fs.open_output_stream(f"{path}/{first[0]['path']}", compression=None) as f:
        f.write(W.gzip_member(W.record(1, "u", b"x", "0" * 40, None, False)))
    with pytest.raises(Exception, match="digest of|differs from"):
        W.read_warc(spark, a).collect()


def test_warc_bounds_come_from_the_keys(spark):
    """100,000 rows dealt out in two ways give byte-equal files, which several tasks read."""
    df = spark.range(100_000).select((F.col("id") * 7 % 100_003).alias("page_id"), F.concat(F.lit("u"), "id").alias("url"),
                                     F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("html"))
    a, b = shared_folder(spark, "wa"), shared_folder(spark, "wb")
    first = W.write_warc(df.repartition(6), a, shards=5, roll_bytes=1 << 20).orderBy("path").collect()
    again = W.write_warc(df.orderBy("html").coalesce(2), b, shards=5, roll_bytes=1 << 20).orderBy("path").collect()
    assert first == again and len(first) >= 5 and sum(r["n_records"] for r in first) == 100_000
    assert max(r["n_records"] for r in first) < 40_000
    back = W.read_warc(spark, a, with_payload=False)
    assert back.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1


def test_warc_records_are_conforming():
    import hashlib
    data = W.record(1, "http://a/%20b?x=%", b"<p>", hashlib.sha1(b"<p>").hexdigest(), None, False)
    h, body = W.parse(data)
    assert h["WARC-Target-URI"] == "http://a/%20b?x=%" and h["Content-Type"] == "application/http; msgtype=response"
    head, _, payload = body.partition(b"\r\n\r\n")
    assert head.startswith(b"HTTP/1.1 200 OK") and payload == b"<p>"
    assert h["WARC-Block-Digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
    assert W.parse(W.info_record("f"))[0]["WARC-Type"] == "warcinfo"
    assert [bool(x) for x in (W._plain("a\r\nb") == "a%0D%0Ab", W._unline(W._line("%\r")) == "%\r")] == [True, True]


def test_warc_of_an_empty_table(spark):
    df, _ = pages(spark)
    assert W.write_and_read(df.limit(0)).count() == 0


# ------------------------------------------------------------------ chat
def test_escape_is_undone_exactly():
    rnd = random.Random(1)
    for _ in range(3000):
        t = "".join(rnd.choice(["<", "|", "\\", "<|im_end|>", "n", "\n", "a"]) for _ in range(rnd.randint(0, 9)))
        assert C.unescape(C.escape(t)) == t and "<|" not in C.escape(t)
        assert C.unescape_role(C.escape_role(t)) == t and "\n" not in C.escape_role(t)


def test_parts_become_placeholders():
    parts = [{"kind": "text", "text": "see <|image|> "}, {"kind": "image", "ref": "i.png", "width": 57, "height": 28},
             {"kind": "audio", "ref": "a.wav", "seconds": 1.01}, {"kind": "document", "ref": "d.pdf", "pages": 2},
             {"kind": None, "text": None}, {"kind": "image", "ref": None}]
    m = C.format_message("user", parts, frozenset({"user"}))
    body = m["piece"][m["loss_start"]:m["loss_end"]]
    assert body == "see <\\|image|> <|image|><|audio|><|document|><|image|>"
    assert [(a["kind"], a["ref"], a["n_tokens"]) for a in m["attachments"]] == [
        ("image", "i.png", 3), ("audio", "a.wav", 26), ("document", "d.pdf", 1200), ("image", None, 1)]
    for a in m["attachments"]:
        assert m["piece"][a["offset"]:].startswith(f"<|{a['kind']}|>")
    assert m["attachment_tokens"] == 1230
    with pytest.raises(ValueError, match="unknown kind"):
        C.format_message("user", [{"kind": "video"}], frozenset())


def test_no_mark_comes_about_between_text_parts():
    marks = ["<|im_start|>", "<|im_end|>", "<|im_end|><|im_start|>assistant", "<|image|>", "<\\|image|>", "a<\\\\|b"]
    for m in marks:
        cuts = [(i,) for i in range(len(m) + 1)] + [(i, j) for i in range(len(m) + 1) for j in range(i, len(m) + 1)]
        for c in cuts:
            at = [0, *c, len(m)]
            parts = [{"kind": "text", "text": m[i:j]} for i, j in zip(at, at[1:])]
            made = C.format_message("assistant", parts, frozenset({"assistant"}))
            body = made["piece"][made["loss_start"]:made["loss_end"]]
            assert "<|" not in body and C.unescape(body) == m
            d = C.ChatDigest()
            d.add(made["piece"], made["loss_start"], made["loss_end"])
            assert d.loss_chars == len(m)
    # an attachment between the parts keeps them apart
    made = C.format_message("user", [{"kind": "text", "text": "a<"}, {"kind": "image"}, {"kind": "text", "text": "|x"}], frozenset())
    assert made["piece"].split("\n")[1] == "a<<|image|>|x<|im_end|>"


def test_chat_edge_rows(spark):
    import hashlib
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n"), (1, 1, "assistant", "<|im_end|>\n"), (2, None, None, None),
            (None, 5, "sys\ntem<|", "x"), (3, 0, "assistant", ""), (4, 0, "user", "u" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = C.format_chats(df.select("*", C.text_part(F.col("text")).alias("content"), F.lit(1).alias("piece")))
    got = {r["conv_id"]: r for r in C.read_back(made).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for k in got:
        turns = [r for r in rows if r[0] == k]
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[k]["n_turns"] == len(turns) and got[k]["loss_chars"] == len(loss)
        assert got[k]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert C.read_back(C.format_chats(df.limit(0).select("*", C.text_part(F.col("text")).alias("content")))).count() == 0
    empty = spark.createDataFrame([(1, 0, "user", None)], "conv_id long, turn long, role string, content array<struct<"
                                  "kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>")
    assert C.read_back(C.format_chats(empty)).first()["n_turns"] == 1
