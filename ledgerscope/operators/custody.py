"""Custody operators K1-K9 as jobs over many files, tables, records and cases.

* K1 ``digest_files``: SHA-256, MD5 and size of every listed file; files are spread over
  tasks and each is streamed in 4 MiB chunks on an executor (any size, any filesystem
  pyarrow can open), so files are hashed in parallel.  A folder (a table of many files) is one item:
  the digest of its files' names and digests.
* K2 ``digest_table``: order-sensitive, column-order-insensitive table digest, built as
  a tree of bounded groups (rows -> 4096-row chunks -> 4096-chunk blocks -> root).
* K4 ``sign_records`` / ``verify_signatures``: HMAC-SHA256 over canonical JSON, JVM-side.
* K5-K8 manifests: hash of the item digests concatenated in ``seq`` order, per case.  The digests
  are sorted and joined into chunks in parallel; only the hashing itself is one stream per case.
  A manifest is a header row and a table of numbered item rows (``finalize_rows``), or one
  nested document per case (``finalize``, for cases whose items fit in one row).
* K9 ``report_signature``: HMAC of (case_id, custody_hash, generated_at), with
  ``generated_at`` stored next to the signature so it can be re-verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.functions.core import canonical_json, global_running_sum, hmac_sha256
from ledgerscope.session import ship_package

CHUNK = 4 * 1024 * 1024
DIGESTS_AT_ONCE = 128           # item digests in a row of ``manifest_hash``

FILE_DIGEST_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("exists", T.BooleanType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("md5", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("error", T.StringType()),
])


def _open(path: str):
    from pyarrow import fs as pafs
    if path.startswith("file:"):
        filesystem, p = pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    elif "://" in path:
        filesystem, p = pafs.FileSystem.from_uri(path)
    else:
        filesystem, p = pafs.LocalFileSystem(), path
    return filesystem, p


def _digest_partition(batches):
    import pandas as pd
    from pyarrow import fs as pafs
    for pdf in batches:
        out = []
        for path in pdf["path"]:
            try:
                filesystem, p = _open(path)
                info = filesystem.get_file_info(p)
                if info.type != pafs.FileType.File:
                    out.append((path, False, None, None, None, None))
                    continue
                sha, md5 = hashlib.sha256(), hashlib.md5()
                with filesystem.open_input_stream(p) as f:
                    while True:
                        block = f.read(CHUNK)
                        if not block:
                            break
                        sha.update(block)
                        md5.update(block)
                out.append((path, True, sha.hexdigest(), md5.hexdigest(), int(info.size), None))
            except FileNotFoundError:
                out.append((path, False, None, None, None, None))
            except OSError as e:           # there, but unreadable: not the same as missing
                out.append((path, True, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(out, columns=[f.name for f in FILE_DIGEST_SCHEMA.fields])


FILE_SIZE_SCHEMA = "path string, size long"


def _size_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pandas as pd
    for pdf in batches:
        out = []
        for path in pdf["path"]:
            size = None
            try:
                filesystem, p = _open(path)
                size = filesystem.get_file_info(p).size
            except OSError:
                pass                       # reported by the digest
            out.append((path, size))
        yield pd.DataFrame({"path": [p for p, _ in out], "size": pd.array([n for _, n in out], "Int64")})


def file_sizes(paths: DataFrame, tasks: int | None = None) -> DataFrame:
    """(path, size) of the distinct files of ``paths``; size NULL: no such file."""
    ship_package(paths.sparkSession)
    n = tasks or max(1, paths.sparkSession.sparkContext.defaultParallelism)
    return paths.select("path").distinct().repartition(n).mapInPandas(_size_partition, FILE_SIZE_SCHEMA)


FILE_LIST_SCHEMA = "path string, folder boolean, file string, name string, size long, error string"


def _list_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pandas as pd
    from pyarrow import fs as pafs
    for pdf in batches:
        out = []
        for path in pdf["path"]:
            try:
                filesystem, p = _open(path)
                info = filesystem.get_file_info(p)
                if info.type == pafs.FileType.Directory:
                    out.append((path, True, None, None, None, None))
                    start = len(p.rstrip("/"))
                    for f in filesystem.get_file_info(pafs.FileSelector(p, recursive=True)):
                        if f.type == pafs.FileType.File:
                            rest = f.path[start:]
                            file = path.rstrip("/") + (quote(rest) if "://" in path else rest)
                            out.append((path, True, file, rest.lstrip("/"), f.size, None))
                else:
                    out.append((path, False, path, "", info.size, None))
            except OSError as e:
                out.append((path, False, path, "", None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame({c: pd.array([r[i] for r in out], "Int64") if c == "size" else pd.Series([r[i] for r in out], dtype=object)
                            for i, c in enumerate(("path", "folder", "file", "name", "size", "error"))})


def listed_files(paths: DataFrame, tasks: int | None = None) -> DataFrame:
    """The files of the distinct ``paths`` (``FILE_LIST_SCHEMA``): a file itself; of a folder a row without a
    file, and one for each file below it."""
    ship_package(paths.sparkSession)
    n = tasks or max(1, paths.sparkSession.sparkContext.defaultParallelism)
    return paths.select("path").distinct().repartition(n).mapInPandas(_list_partition, FILE_LIST_SCHEMA)


def by_size(sizes: DataFrame, tasks: int) -> DataFrame:
    """Rows ``path, size`` dealt to ``tasks`` partitions, largest first: a file goes where the running
    total of the files before it falls, so no task has more than the mean and one file.
    A file counts as a kilobyte at least (opening it costs, too)."""
    cost = sizes.select("path", F.greatest(F.coalesce("size", F.lit(0)), F.lit(1024)).cast("long").alias("cost")).withColumn(
        "_k", F.struct((-F.col("cost")).alias("c"), "path"))
    ranked = global_running_sum(cost, "_k", ["cost"])
    total = ranked.agg(F.sum("cost")).scalar()
    task = F.floor((F.col("cum_cost") - F.col("cost")) * tasks / total).cast("int")
    return ranked.select("path", F.col("cost").alias("size"), F.least(task, F.lit(tasks - 1)).alias("task")).repartitionById(
        tasks, F.col("task"))


def digest_files(paths: DataFrame, tasks: int | None = None) -> DataFrame:
    """K1 for every row of ``paths`` (column ``path``; other columns pass through).

    Adds ``exists, sha256, md5, file_size, error, filename, acquired_at``.  A missing file gives
    ``exists = false`` and NULL digests; one that can't be read NULL digests and the ``error``.
    A folder's digests are those of the lines ``name``, space, digest of the file, of all files below it in
    the order of their names; its size is their sum.
    The files' sizes are listed first and decide which of ``tasks`` tasks (the session's
    parallelism by default) reads which files.
    """
    spark = paths.sparkSession
    ship_package(spark)  # the hashing runs in Python workers
    n = tasks or max(1, spark.sparkContext.defaultParallelism)
    listed = listed_files(paths, n)
    sizes = listed.where(F.col("file").isNotNull()).groupBy(F.col("file").alias("path")).agg(F.max("size").alias("size"))
    each = by_size(sizes, n).select("path").mapInPandas(_digest_partition, FILE_DIGEST_SCHEMA).withColumnsRenamed(
        {"path": "file", "error": "_error"})
    files = listed.join(each, "file", "left")
    of_folder = F.col("folder") & F.col("file").isNotNull()

    def digest(kind: str) -> Column:
        """The file's own, or that of the folder's lines."""
        entries = F.array_sort(F.collect_list(F.when(of_folder, F.struct("name", F.col(kind).alias("digest")))))
        lines = F.concat_ws("", F.transform(entries, lambda x: F.concat(x["name"], F.lit(" "), x["digest"], F.lit("\n"))))
        whole = F.sha2(lines, 256) if kind == "sha256" else F.md5(lines)
        known = F.count_if(of_folder & F.col(kind).isNull()) == 0
        return F.when(F.bool_or("folder"), F.when(known, whole)).otherwise(F.max(kind)).alias(kind)

    gone = F.when(of_folder & F.col("sha256").isNull(), F.concat(F.lit("gone while read: "), "name"))
    dig = files.groupBy("path").agg(
        (F.bool_or("folder") | F.coalesce(F.bool_or("exists"), F.lit(False))).alias("exists"), digest("sha256"), digest("md5"),
        F.when(F.bool_or("folder"), F.coalesce(F.sum("file_size"), F.lit(0))).otherwise(F.max("file_size")).alias("file_size"),
        F.max(F.coalesce("_error", "error", gone)).alias("error"))
    return paths.join(dig, "path", "left").withColumns({
        "filename": F.element_at(F.split("path", "/"), -1),
        "acquired_at": F.current_timestamp(),
    })


def verify_files(expected: DataFrame) -> DataFrame:
    """K3: ``expected`` has ``path, sha256``; adds ``verified`` (false when missing)."""
    got = digest_files(expected.select("path").distinct()).select(
        "path", F.col("sha256").alias("_actual"))
    return expected.join(got, "path", "left").withColumn(
        "verified", F.coalesce(F.col("_actual") == F.col("sha256"), F.lit(False))).drop("_actual")


# ------------------------------------------------------------------ K2
def row_digests(df: DataFrame, cols: list[str] | None = None) -> Column:
    return F.sha2(canonical_json(df, cols), 256)


def _tree_level(df: DataFrame, idx: str, digest: str, fanout: int) -> DataFrame:
    grouped = df.groupBy(F.floor(F.col(idx) / fanout).alias("_g")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(digest).alias("d"))))
        .alias("_items"))
    return grouped.select(F.col("_g").alias(idx), F.sha2(F.array_join(
        F.transform("_items", lambda x: x["d"]), ""), 256).alias(digest))


def digest_table(df: DataFrame, order_by: list[str], cols: list[str] | None = None,
                 fanout: int = 4096, label: str | None = None) -> DataFrame:
    """K2: one row ``(label, n_rows, sha256)`` for the rows of ``df`` in ``order_by`` order.

    ``order_by`` must be a unique key (the digest is order-sensitive).  Every group in
    the tree holds at most ``fanout`` digests; the root holds n / fanout^2.
    """
    names = cols if cols is not None else [c for c in df.columns]
    rows = df.select(*order_by, row_digests(df, names).alias("d"), F.lit(1).alias("one"))
    ranked = global_running_sum(rows.withColumn("_k", F.struct(*order_by)), "_k", ["one"])
    level = ranked.select((F.col("cum_one") - 1).alias("i"), "d")
    l1 = _tree_level(level, "i", "d", fanout)
    l2 = _tree_level(l1, "i", "d", fanout)
    root = l2.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("i", "d"))), lambda x: x["d"]), ""), 256).alias("sha256"))
    n = ranked.agg(F.count(F.lit(1))).scalar()  # from the materialised frame
    return root.select(F.lit(label).cast("string").alias("label"), n.alias("n_rows"), "sha256")


# ------------------------------------------------------------------ K4
def sign_records(df: DataFrame, key: str, cols: list[str] | None = None,
                 out: str = "signature") -> DataFrame:
    """K4: HMAC-SHA256 of each row's canonical JSON (sorted keys) under ``key``."""
    names = cols if cols is not None else df.columns
    return df.withColumn(out, hmac_sha256(canonical_json(df, names), key))


def verify_signatures(df: DataFrame, key: str, cols: list[str], sig: str = "signature"
                      ) -> DataFrame:
    return df.withColumn("signature_valid",
                         F.col(sig) == hmac_sha256(canonical_json(df, cols), key))


# ------------------------------------------------------------------ K5-K8
def manifest_items(files: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """K5: manifest items of file digests (K1 rows with ``case_id, seq``) and table digests
    (K2 rows with ``case_id, seq, label``), one schema."""
    parts = []
    if files is not None:
        parts.append(files.select(
            "case_id", "seq", F.lit("file").alias("type"), F.col("path").alias("filepath"),
            "filename", "file_size", "sha256", "md5",
            F.col("acquired_at").cast("string").alias("acquired_at"),
            F.coalesce(F.col("notes") if "notes" in files.columns else F.lit(""), F.lit(""))
            .alias("notes"), F.lit(None).cast("string").alias("label")))
    if tables is not None:
        parts.append(tables.select(
            "case_id", "seq", F.lit("dataframe").alias("type"),
            F.lit(None).cast("string").alias("filepath"), F.lit(None).cast("string").alias("filename"),
            F.lit(None).cast("long").alias("file_size"), "sha256",
            F.lit(None).cast("string").alias("md5"),
            F.current_timestamp().cast("string").alias("acquired_at"),
            F.lit(None).cast("string").alias("notes"), "label"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``case_id, part, no, n, digests`` of sorted rows ``case_id, sha256``: at most
    DIGESTS_AT_ONCE digests of a case, joined; NULL digests only count."""
    part, no = TaskContext.get().partitionId(), 0
    key, n, held = None, 0, []
    for b in batches:
        out = []
        for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if n and (k != key or n == DIGESTS_AT_ONCE):
                out.append((key, part, no, n, "".join(held)))
                no, n, held = no + 1, 0, []
            key, n = k, n + 1
            if d is not None:
                held.append(d)
        if out:
            yield _batch(out, b.schema.field(0).type)
        kind = b.schema.field(0).type
    if n:
        yield _batch([(key, part, no, n, "".join(held))], kind)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                      ["case_id", "part", "no", "n", "digests"])


def _hashed_cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``case_id, manifest_hash, n_items`` of the chunks in order; holds one hash at a time."""
    key, digest, n = None, None, 0

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, [kind, pa.string(), pa.int64()], strict=True)],
            ["case_id", "manifest_hash", "n_items"])

    for b in batches:
        out, kind = [], b.schema.field(0).type
        for k, m, text in zip(*[b.column(i) for i in range(3)], strict=True):
            k = k.as_py()
            if digest is None or k != key:
                if digest is not None:
                    out.append((key, digest.hexdigest(), n))
                key, digest, n = k, hashlib.sha256(), 0
            digest.update(text.as_py().encode())
            n += m.as_py()
        if out:
            yield batch(out)
    if digest is not None:
        yield batch([(key, digest.hexdigest(), n)])


def manifest_hash(items: DataFrame, order: str = "seq") -> DataFrame:
    """K6 / D-14: per case, SHA-256 of the item digests joined in ``order`` order.

    The items are range-sorted in parallel and their digests joined into chunks of
    DIGESTS_AT_ONCE.  The hash is sequential, so a case's chunks are one stream in one task, which
    holds a batch of them (the sort spills), whatever the number of items.
    """
    ship_package(items.sparkSession)
    rows = items.select("case_id", F.col(order).alias("_o"), "sha256")
    kind = rows.schema["case_id"]
    chunks = (rows.repartitionByRange("case_id", "_o", "sha256")
              .sortWithinPartitions("case_id", "_o", "sha256").select("case_id", "sha256")
              .mapInArrow(_joined_digests, T.StructType([
                  kind, T.StructField("part", T.IntegerType()), T.StructField("no", T.LongType()),
                  T.StructField("n", T.LongType()), T.StructField("digests", T.StringType())])))
    return (chunks.repartition("case_id").sortWithinPartitions("case_id", "part", "no")
            .select("case_id", "n", "digests")
            .mapInArrow(_hashed_cases, T.StructType([
                kind, T.StructField("manifest_hash", T.StringType()),
                T.StructField("n_items", T.LongType(), False)])))


def numbered(items: DataFrame, order: str = "seq") -> DataFrame:
    """``items`` with ``pos``: 0, 1, ... per case in (``order``, digest) order, the order of
    ``manifest_hash``."""
    rest = [c for c in items.columns if c not in ("case_id", order, "sha256")]
    keyed = items.withColumns({"_k": F.struct("case_id", order, "sha256", *rest), "_one": F.lit(1)})
    ranked = global_running_sum(keyed, "_k", ["_one"], prefix="_to").drop("_k", "_one")
    first = ranked.groupBy(F.col("case_id").alias("_case")).agg(F.min("_to_one").alias("_first"))
    return (ranked.join(first, F.col("case_id").eqNullSafe(F.col("_case")))
            .withColumn("pos", F.col("_to_one") - F.col("_first")).select(*items.columns, "pos"))


def finalize_rows(items: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K6 with any number of items: the header rows (``case_id, investigator, manifest_hash,
    n_items, finalized_at``) and the item rows (``items`` of these cases with ``pos``)."""
    head = cases.select(F.col("id").alias("case_id"), "investigator")
    known = head.select(F.col("case_id").alias("_id"))
    rows = numbered(items).join(known, F.col("case_id").eqNullSafe(F.col("_id")), "left_semi")
    made = manifest_hash(rows, "pos").withColumnRenamed("case_id", "_id")
    head = head.join(made, F.col("case_id").eqNullSafe(F.col("_id")), "left").select(
        "case_id", "investigator",
        F.coalesce("manifest_hash", F.lit(hashlib.sha256(b"").hexdigest())).alias("manifest_hash"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.current_timestamp().cast("string").alias("finalized_at"))
    return head, rows


def finalize(items: DataFrame, cases: DataFrame) -> DataFrame:
    """K6: one manifest per case: header + nested items.  All items of a case are in one row;
    ``finalize_rows`` has no such bound."""
    nested = items.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(
        *[c for c in items.columns if c != "case_id"]))).alias("items"))
    head = cases.select(F.col("id").alias("case_id"), "investigator")
    return (head.join(manifest_hash(items), "case_id", "left").join(nested, "case_id", "left")
            .withColumn("manifest_hash", F.coalesce("manifest_hash",
                                                    F.lit(hashlib.sha256(b"").hexdigest())))
            .withColumn("finalized_at", F.current_timestamp().cast("string")))


def write_manifests(manifests: DataFrame, path: str) -> None:
    """A8 sink: one JSON document per case."""
    manifests.write.mode("overwrite").json(path)


ITEM_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("type", T.StringType()),
    T.StructField("filepath", T.StringType()), T.StructField("filename", T.StringType()),
    T.StructField("file_size", T.LongType()), T.StructField("sha256", T.StringType()),
    T.StructField("md5", T.StringType()), T.StructField("acquired_at", T.StringType()),
    T.StructField("notes", T.StringType()), T.StructField("label", T.StringType())])
MANIFEST_SCHEMA = T.StructType([
    T.StructField("case_id", T.StringType()), T.StructField("investigator", T.StringType()),
    T.StructField("manifest_hash", T.StringType()), T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(ITEM_SCHEMA)), T.StructField("finalized_at", T.StringType())])


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


def write_manifest_rows(head: DataFrame, items: DataFrame, path: str) -> None:
    """Header and item rows of ``finalize_rows``, one JSON line each, in two folders."""
    head.write.mode("overwrite").json(f"{path.rstrip('/')}/manifests")
    items.write.mode("overwrite").json(f"{path.rstrip('/')}/items")


HEAD_SCHEMA = T.StructType([f for f in MANIFEST_SCHEMA.fields if f.name != "items"])
ITEM_ROW_SCHEMA = T.StructType([MANIFEST_SCHEMA["case_id"], *ITEM_SCHEMA.fields,
                                T.StructField("pos", T.LongType())])


def read_manifest_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The header and item rows that ``write_manifest_rows`` wrote."""
    return (spark.read.schema(HEAD_SCHEMA).json(f"{path.rstrip('/')}/manifests"),
            spark.read.schema(ITEM_ROW_SCHEMA).json(f"{path.rstrip('/')}/items"))


def _failed_tables(items: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame | None:
    """(case_id, item) of the table items whose table has another digest now."""
    now = None
    for label, (df, order_by) in tables.items():
        one = digest_table(df, order_by, label=label).select(F.col("label").alias("_label"), F.col("sha256").alias("_now"))
        now = one if now is None else now.unionByName(one)
    if now is None:
        return None
    own = items.where(F.col("type") == "dataframe").select("case_id", F.col("label").alias("item"), "sha256")
    return own.join(now, F.col("item") == F.col("_label")).where(
        ~F.col("_now").eqNullSafe(F.col("sha256"))).select("case_id", "item")


def verify_manifest(manifests: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]] | None = None) -> DataFrame:
    """K7: per case ``(valid, failed_items)``: the header hash against the items in their stored
    order, every file item against a fresh digest of its file, and the table items named in
    ``tables`` (label -> (table, order columns) of ``digest_table``) against a fresh digest.
    A manifest without items is valid if its hash is that of no digests."""
    items = manifests.select("case_id", F.posexplode("items").alias("_pos", "it"))
    flat = items.select("case_id", "_pos", "it.*")
    recomputed = manifest_hash(flat, "_pos")
    files = flat.where(F.col("type") == "file").select(
        "case_id", F.col("filepath").alias("path"), "sha256", "filename")
    failed_items = verify_files(files).where(~F.col("verified")).select("case_id", F.coalesce("filename", "path").alias("item"))
    failed_tables = _failed_tables(flat, tables or {})
    if failed_tables is not None:
        failed_items = failed_items.unionByName(failed_tables)
    bad_files = failed_items.groupBy("case_id").agg(F.array_sort(F.collect_list("item")).alias("bad"))
    head = manifests.select("case_id", F.col("manifest_hash").alias("stored"))
    j = head.join(recomputed, "case_id", "left").join(bad_files, "case_id", "left")
    hash_ok = F.col("stored") == F.coalesce(F.col("manifest_hash"),
                                            F.lit(hashlib.sha256(b"").hexdigest()))
    failed = F.concat(F.when(hash_ok, F.array().cast("array<string>")).otherwise(
        F.array(F.lit("manifest_hash"))), F.coalesce("bad", F.array().cast("array<string>")))
    return j.select("case_id", (F.size(failed) == 0).alias("valid"), failed.alias("failed_items"))


def verify_manifest_rows(head: DataFrame, items: DataFrame, fresh: DataFrame | None = None,
                         tables: dict[str, tuple[DataFrame, list[str]]] | None = None) -> DataFrame:
    """K7 for manifests of any size (``finalize_rows``): one row ``case_id, item`` per failure; none
    means valid.

    ``manifest_hash`` fails where the items, streamed in their order, have another hash or number;
    a file item fails unless ``fresh`` (``filepath, sha256``; by default the files read anew) has
    its digest (an anti-join); a table item as in ``verify_manifest``.
    """
    made = manifest_hash(items, "pos").select(F.col("case_id").alias("_id"), F.col("manifest_hash").alias("_hash"), F.col("n_items").alias("_n"))
    j = head.join(made, F.col("case_id").eqNullSafe(F.col("_id")), "left")
    ok = (F.col("manifest_hash") == F.coalesce("_hash", F.lit(hashlib.sha256(b"").hexdigest()))) & (
        F.coalesce("n_items", "_n", F.lit(0)) == F.coalesce("_n", F.lit(0)))
    failed = j.where(~F.coalesce(ok, F.lit(False))).select("case_id", F.lit("manifest_hash").alias("item"))
    files = items.where(F.col("type") == "file").select("case_id", F.col("filepath").alias("path"), "filename", "sha256")
    if fresh is None:
        fresh = digest_files(files.select("path").distinct()).select(F.col("path").alias("filepath"), "sha256")
    fresh = fresh.select(F.col("filepath").alias("_path"), F.col("sha256").alias("_now"))
    missing = files.join(fresh, (F.col("path") == F.col("_path")) & (F.col("sha256") == F.col("_now")), "left_anti")
    failed = failed.unionByName(missing.select("case_id", F.coalesce("filename", "path").alias("item")))
    failed_tables = _failed_tables(items, tables or {})
    return failed if failed_tables is None else failed.unionByName(failed_tables)


def custody_from_evidence(evidence: DataFrame) -> DataFrame:
    """K8: manifest items rebuilt from stored evidence rows (no re-hash); seq = acquisition
    order then id, numbered over range partitions (``numbered``)."""
    rows = evidence.select("case_id", F.struct("acquired_at", "id").alias("_order"), F.col("sha256_hash").alias("sha256"),
                           F.col("filename").alias("filepath"), "file_size", F.col("md5_hash").alias("md5"), "acquired_at", "notes")
    return numbered(rows, "_order").select(
        "case_id", (F.col("pos") + 1).cast("int").alias("seq"), F.lit("file").alias("type"), "filepath",
        F.element_at(F.split("filepath", "/"), -1).alias("filename"), "file_size", "sha256", "md5",
        F.col("acquired_at").cast("string").alias("acquired_at"),
        F.coalesce("notes", F.lit("")).alias("notes"), F.lit(None).cast("string").alias("label"))


def report_signature(manifests: DataFrame, key: str) -> DataFrame:
    """K9: HMAC of {case_id, custody_hash, generated_at} per case; the timestamp is kept."""
    rec = manifests.select("case_id", F.col("manifest_hash").alias("custody_hash"),
                           F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
                           .alias("generated_at"))
    return sign_records(rec, key, ["case_id", "custody_hash", "generated_at"])
