"""Stored digest trees of tables: K2 that says not only whether, but where a table has changed.

Rows are placed by the hash of their key: the first bits of the hash are the row's leaf, each further
level of the tree drops four bits.  So an inserted, removed or changed row alters one leaf and the
nodes above it, and nothing else moves.  A leaf's digest is that of its sorted row digests, a
node's that of its children's.  Two trees are compared from the top: only the children of nodes that
differ are read, a logarithmic number of nodes for each change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions.core import canonical_json

#: Bits of a level (16 children to a node).
BITS = 4


def _depth(n_rows: int, rows_per_leaf: int) -> int:
    """Levels below the root at which a leaf has about ``rows_per_leaf`` rows or fewer."""
    depth = 0
    while n_rows > rows_per_leaf << (BITS * depth) and depth < 15:
        depth += 1
    return depth


def tree_rows(df: DataFrame, key: list[str], cols: list[str] | None, depth: int) -> DataFrame:
    """(leaf, key, sha256) of every row; ``key`` is a struct."""
    names = cols if cols is not None else df.columns
    hashed = F.xxhash64(*[F.col(f"`{k}`") for k in key])
    leaf = F.shiftrightunsigned(hashed, 64 - BITS * depth) if depth else F.lit(0).cast("long")
    return df.select(leaf.alias("leaf"), F.struct(*[F.col(f"`{k}`") for k in key]).alias("key"),
                     F.sha2(canonical_json(df, names), 256).alias("sha256"))


def tree_nodes(rows: DataFrame, depth: int) -> DataFrame:
    """(level, node, n_rows, sha256) of all levels, leaves to root (level 0).  A node without rows
    is absent, but for the root."""
    joined = F.array_join(F.array_sort(F.collect_list("sha256")), "")
    level = rows.groupBy(F.col("leaf").alias("node")).agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(joined, 256).alias("sha256"))
    out = level.withColumn("level", F.lit(depth))
    for h in range(depth - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("node", "sha256")))
        text = F.array_join(F.transform(children, lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["sha256"])), "\n")
        level = level.groupBy(F.shiftright("node", BITS).alias("node")).agg(
            F.sum("n_rows").alias("n_rows"), F.sha2(text, 256).alias("sha256"))
        out = out.unionByName(level.withColumn("level", F.lit(h)))
    return out.select("level", "node", "n_rows", "sha256")


def write_digest_tree(df: DataFrame, key: list[str], path: str, cols: list[str] | None = None,
                      rows_per_leaf: int = 512) -> None:
    """Store the tree of ``df`` under ``path``: its nodes by level, and the rows' digests by leaf.

    ``key`` should be unique: the rows of a key share a leaf.  Leaves are sorted in the files, so a
    lookup of some leaves skips the rest.
    """
    depth = _depth(df.count(), rows_per_leaf)
    path = path.rstrip("/")
    (tree_rows(df, key, cols, depth).repartitionByRange("leaf").sortWithinPartitions("leaf")
     .write.mode("overwrite").parquet(f"{path}/rows"))
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    nodes = tree_nodes(rows, depth)
    if rows.isEmpty():                # a root alone
        nodes = df.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("node"),
                                                F.lit(0).cast("long").alias("n_rows"), F.sha2(F.lit(""), 256).alias("sha256"))
    nodes.write.mode("overwrite").partitionBy("level").parquet(f"{path}/nodes")


def read_digest_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, rows) of a stored tree."""
    path = path.rstrip("/")
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/rows")


def tree_root(spark: SparkSession, path: str) -> str:
    nodes, _ = read_digest_tree(spark, path)
    return nodes.where("level = 0").first()["sha256"]


def differing_leaves(old: DataFrame, new: DataFrame, depth: int) -> DataFrame:
    """``leaf`` of the leaves in which two trees of one depth differ, found from the top."""
    found = None
    for level in range(depth + 1):
        a, b = (t.where(F.col("level") == level).select("node", "sha256") for t in (old, new))
        if found is not None:
            a, b = (t.withColumn("_up", F.shiftright("node", BITS)).join(found, "_up", "left_semi").drop("_up") for t in (a, b))
        a, b = a.withColumnRenamed("sha256", "was"), b.withColumnRenamed("sha256", "is")
        differ = a.join(b, "node", "full").where(~F.col("was").eqNullSafe(F.col("is")))
        found = differ.select(F.col("node").alias("_up"))
    return found.select(F.col("_up").alias("leaf"))


def verify_table(df: DataFrame, key: list[str], path: str, cols: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` that aren't as when the tree under ``path`` was stored: ``key`` columns and
    ``change`` (added, removed or changed).  No rows: the table is the same.

    The table's digests are made anew; of the stored tree, the nodes above the changes and the rows of
    the changed leaves are read.  Rows that share a key count as changed if their digests differ as a bag.
    """
    nodes, rows = read_digest_tree(df.sparkSession, path)
    depth = nodes.agg(F.max("level")).first()[0]
    now = tree_rows(df, key, cols, depth)
    leaves = differing_leaves(nodes, tree_nodes(now, depth), depth)

    def bags(t: DataFrame, name: str) -> DataFrame:
        return t.join(leaves, "leaf", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list("sha256")).alias(name))

    was, here = bags(rows, "was"), bags(now, "is").withColumnRenamed("key", "_key")
    both = was.join(here, F.col("key").eqNullSafe(F.col("_key")), "full").where(~F.col("was").eqNullSafe(F.col("is")))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("changed")
    return both.select(F.coalesce("key", "_key").alias("key"), change.alias("change")).select("key.*", "change")
