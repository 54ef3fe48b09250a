"""URL filters: host/path rules, then a blocked Bloom filter of listed canonical URLs.

The listed URLs become a split-block Bloom filter kept as a table: one row per 512-bit block
with eight 64-bit words.  A URL sets (or tests) exactly one bit in each of the eight words of
its block, so a probe is one hash join on the block number and eight bit tests, all in
generated code.  Only possible hits go on to the exact hash join with the list, which removes
the false positives; a listed URL is never missed.

Defined cases: a NULL URL or one without ``://`` has empty host and path, no canonical form,
fits no rule and is never listed.  Repeated rows are judged alike and all kept.  NULL listed
URLs are ignored.  An empty list or table gives no hit.  Other columns of the input are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import ascii_lower

#: (verdict, host, path) of the query's rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"),
         ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Query parameters that do not identify a page (fixed values).
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=.*)?$"

WORDS = 8                    # 64-bit words of a block
BLOCK_BYTES = 8 * (WORDS + 1)


def host_path(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a URL; all empty for NULL or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = rest.substr(F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    query = F.regexp_extract(tail, r"^[^?#]*\?([^#]*)", 1)
    empty = F.lit("")
    return (F.coalesce(ascii_lower(host), empty), F.coalesce(path, empty),
            F.coalesce(query, empty))


def canonical(host: Column, path: Column, query: Column) -> Column:
    """Scheme-free canonical form: host without default port and ``www.``, path without a
    trailing slash, query without tracking parameters and in sorted order, no fragment.
    NULL where there is no host."""
    h = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    params = F.array_sort(F.filter(F.split(query, "&"),
                                   lambda p: (p != "") & ~p.rlike(TRACKING)))
    q = F.array_join(params, "&")
    return F.when(host != "", F.concat(h, F.regexp_replace(path, r"/+$", ""),
                                       F.when(q != "", F.concat(F.lit("?"), q))
                                       .otherwise(F.lit(""))))


def rule_match(host: Column, path: Column,
               rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the URL's or a parent domain of it and
    whose path starts the URL's path; NULLs where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _masks(key: Column) -> list[Column]:
    """One single-bit mask for each word of the block, six hash bits each (48 of 64 used)."""
    h = F.xxhash64(F.lit(97), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(WORDS)]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks).cast("long"))


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter: ``block`` and ``w0..w7``; blocks without a key have no row."""
    k = F.col(key)
    bits = [m.alias(f"m{i}") for i, m in enumerate(_masks(k))]
    return (keys.where(k.isNotNull()).select(_block(k, n_blocks).alias("block"), *bits)
            .groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)]))


def possible_hits(df: DataFrame, key: str, blocks: DataFrame, n_blocks: int,
                  broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Rows of ``df`` whose ``key`` passes the filter (a superset of the listed ones).

    The block table has at most ``n_blocks`` rows of 72 bytes: below ``broadcast_bytes`` it is
    broadcast, above it both sides are shuffled by block number (hashes spread evenly).
    """
    b = blocks.select(F.col("block").alias("_block"),
                      *[F.col(f"w{i}").alias(f"_w{i}") for i in range(WORDS)])
    if n_blocks * BLOCK_BYTES <= broadcast_bytes:
        b = F.broadcast(b)
    test = F.lit(True)
    for i, m in enumerate(_masks(F.col(key))):
        test = test & (F.col(f"_w{i}").bitwiseAND(m) == m)
    return (df.withColumn("_block", _block(F.col(key), n_blocks)).join(b, "_block")
            .where(test).drop("_block", *[f"_w{i}" for i in range(WORDS)]))


def listed_keys(keys: DataFrame, key: str, listed: DataFrame, listed_key: str,
                bits_per_key: int = 16) -> DataFrame:
    """Distinct values of ``key`` in ``keys`` that are listed: the Bloom filter first, then
    the exact hash join.  One row per value, so a hot URL is one row of the join."""
    lst = listed.select(F.col(listed_key).alias(key)).where(F.col(key).isNotNull()).distinct()
    n_blocks = max(1, math.ceil(lst.count() * bits_per_key / (64 * WORDS)))
    blocks = bloom_blocks(lst, key, n_blocks)
    maybe = possible_hits(keys.select(key).where(F.col(key).isNotNull()), key, blocks, n_blocks)
    return maybe.distinct().join(lst, key, "left_semi")


def judge(pages: DataFrame, listed: DataFrame, listed_key: str = "canonical",
          rules: Sequence[tuple[str, str, str]] = RULES, bits_per_key: int = 16) -> DataFrame:
    """Every page with ``page_id, host, path, canonical, rule, listed, verdict``.

    The verdict is the longest fitting rule's; where none fits, ``block`` for a listed
    canonical URL, else ``allow``.
    """
    host, path, query = host_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), query.alias("_q"))
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    keyed = parts.select("page_id", "host", "path",
                         canonical(F.col("host"), F.col("path"), F.col("_q")).alias("canonical"),
                         rule.alias("rule"), verdict.alias("_rule_verdict"))
    hits = listed_keys(keyed, "canonical", listed, listed_key, bits_per_key)
    out = keyed.join(hits.withColumn("_hit", F.lit(True)), "canonical", "left")
    listed_flag = F.coalesce("_hit", F.lit(False))
    return out.select("page_id", "host", "path", "canonical", "rule", listed_flag.alias("listed"),
                      F.coalesce("_rule_verdict", F.when(listed_flag, "block").otherwise("allow"))
                      .alias("verdict"))


def listed_from_hosts(pages: DataFrame, label: str) -> DataFrame:
    """A URL list taken from the table itself: the canonical URLs of every page whose host has
    ``label`` as one of its dot-separated labels."""
    host, path, query = host_path(F.col("url"))
    return (pages.select(host.alias("h"), path.alias("p"), query.alias("q"))
            .where(F.array_contains(F.split("h", r"\."), label))
            .select(canonical(F.col("h"), F.col("p"), F.col("q")).alias("canonical")))
