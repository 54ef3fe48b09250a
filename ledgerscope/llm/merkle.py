"""Document fingerprints: a Merkle tree over paragraphs and sections (DataFrame functions only).

A section ends at a blank line, a paragraph at a line end.  A paragraph's digest is the SHA-256 of
its text, a section's that of its paragraphs' digests in order, the root's that of its sections'
digests and of the text's length.  Paragraphs are cut further into pieces (sentences, at most
``PIECE`` characters); a piece has the first 12 hexadecimal digits of its SHA-256.

The fingerprint is one string: the root, a colon, and the pieces' digests in order.  Equal texts
have equal fingerprints, and differing roots prove a difference.  The likeness of two
fingerprints is 1 for equal roots, else the Dice coefficient of their sets of pieces.

Defined cases: NULL text counts as empty; empty texts have one empty section and no pieces, and
are like each other only.  Rows that share a ``doc_id`` have the same next document: the first
text (in sorted order) of the next larger id.  A NULL id comes before all others.  Repeated
rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.core import global_running_sum
from ledgerscope.llm.common import checkpointed, text_or_empty

PIECE, DIGITS = 96, 12
_SECTION_END = r"\n[ \t]*\n\s*"
_PIECES = r"[^\n.!?]{1,%d}[.!?\n\s]*|[.!?\n\s]+" % PIECE


def sections(text: Column) -> Column:
    """Array of sections, each an array of paragraph digests."""
    return F.transform(F.split(text, _SECTION_END),
                       lambda s: F.transform(F.split(s, "\n"), lambda p: F.sha2(p, 256)))


def section_digests(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda ps: F.sha2(F.array_join(ps, ""), 256))


def root(text: Column) -> Column:
    # the separators that the splits drop are bound by the digest of the whole text's white space
    blanks = F.sha2(F.regexp_replace(text, r"[^\s]+", "."), 256)
    return F.sha2(F.concat(F.array_join(section_digests(sections(text)), ""), blanks), 256)


def pieces(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)),
                       lambda p: F.substring(F.sha2(p, 256), 1, DIGITS))


def fingerprint(text: Column) -> Column:
    return F.concat(root(text), F.lit(":"), F.array_join(pieces(text), ""))


def pieces_of(fp: Column) -> Column:
    """The pieces' digests of a fingerprint (distinct)."""
    body = F.substring_index(fp, ":", -1)
    return F.array_distinct(F.regexp_extract_all(body, F.lit("[0-9a-f]{%d}" % DIGITS), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints alone."""
    pa, pb = pieces_of(a), pieces_of(b)
    total = F.size(pa) + F.size(pb)
    dice = 2.0 * F.size(F.array_intersect(pa, pb)) / total
    return F.when(a == b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(dice)


def nodes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """All nodes of every tree: ``key, level (0 root, 1 section, 2 paragraph), section,
    paragraph, digest``."""
    t = docs.select(F.col(key), text_or_empty("text").alias("_text"))
    secs = t.select(key, F.posexplode(sections(F.col("_text"))).alias("section", "_ps"))
    none = F.lit(None).cast("int")
    return (t.select(key, F.lit(0).alias("level"), none.alias("section"), none.alias("paragraph"),
                     root(F.col("_text")).alias("digest"))
            .unionByName(secs.select(key, F.lit(1).alias("level"), "section", none.alias("paragraph"),
                                     F.sha2(F.array_join("_ps", ""), 256).alias("digest")))
            .unionByName(secs.select(key, "section", F.posexplode("_ps").alias("paragraph", "digest"))
                         .withColumn("level", F.lit(2))))


def locate_edits(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nodes whose digests differ (or that only one side has) between two tables with unique
    keys: the root first, then the sections and the paragraphs below it."""
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (key, "level", "section", "paragraph")]
    j = nodes(old, key).alias("a").join(nodes(new, key).alias("b"), on, "full")
    pick = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in (key, "level", "section", "paragraph")]
    return (j.where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
            .select(*pick, F.col("a.digest").alias("old_digest"), F.col("b.digest").alias("new_digest")))


def row_key(key: Column) -> Column:
    """A key that is never NULL, so that plain equality joins serve NULL ids as well."""
    return F.coalesce(F.concat(F.lit("i"), key.cast("string")), F.lit("n"))


def following(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``k, id, prev, prev_n``: for every distinct id (``k`` its row key) the row key of the id before
    it (of the last for the first) and the length of that id's longest text.

    Ids get their rank from a range-partitioned running count; consecutive ranks are then an
    equi-join, so no task sees more than its range.  Narrow rows only.
    """
    ids = (docs.select(F.col(key).alias("id"), F.length(text_or_empty("text")).alias("n"))
           .groupBy("id").agg(F.max("n").alias("n"), F.lit(1).alias("one"))
           .withColumn("order", F.struct(F.col("id").isNotNull(), "id")))
    ranked = global_running_sum(ids, "order", ["one"], prefix="rank_")
    ranked = checkpointed(ranked.select("id", row_key(F.col("id")).alias("k"), "n", "rank_one"))
    last = ranked.agg(F.max("rank_one")).scalar()
    after = ranked.select(
        F.col("k").alias("prev"), F.col("n").alias("prev_n"),
        F.when(F.col("rank_one") == last, F.lit(1).cast("long"))
        .otherwise(F.col("rank_one") + 1).alias("rank_one"))
    return checkpointed(ranked.join(after, "rank_one").select("k", "id", "prev", "prev_n"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every document's fingerprint, that of its edited text (the last quarter replaced by as much
    of the next document), and their likenesses.

    The texts are shuffled once, by row key: one exchange serves both the documents and, as their
    predecessors' next documents, the messages (the opening that the predecessor needs and a
    fingerprint), which are the only other wide rows that move.
    """
    ids = following(docs, key)
    base = docs.select(row_key(F.col(key)).alias("k"), text_or_empty("text").alias("text"))
    # a running count, as a rank filter would be applied before the exchange too and make it a
    # second one
    w = Window.partitionBy("k").orderBy("text").rowsBetween(Window.unboundedPreceding, 0)
    message = (base.withColumn("_r", F.count(F.lit(1)).over(w)).where(F.col("_r") == 1)
               .join(ids.select("k", "prev", "prev_n"), "k")
               .select(F.col("prev").alias("k"), fingerprint(F.col("text")).alias("next_fp"),
                       F.expr("substring(text, 1, cast(floor(prev_n / 4) as int))").alias("opening")))
    j = base.join(message, "k").join(ids.select("k", "id"), "k")
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    j = j.select("id", n.cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fp"), "next_fp",
                 F.concat(F.col("text").substr(F.lit(1), n - q), F.col("opening").substr(F.lit(1), q))
                 .alias("edited"))
    j = j.withColumn("edited_fp", fingerprint(F.col("edited")))
    return j.select(F.col("id").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                    F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
                    likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                    likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
