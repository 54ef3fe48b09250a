"""Case store: cases, evidence and findings as Parquet tables.

``evidence`` and ``findings`` are partitioned by ``case_id``, so reading one case prunes
partitions.  Replacing or deleting a case's findings appends a row to ``resets`` (case, time): findings
saved before their case's last reset are no longer read.  So a case that is analysed
again without any finding loses its old ones, no path is built from a case id, and a replaced
case's partition is also overwritten where there are new rows (dynamic partition overwrite).
Every write is a batch over many cases / files / findings.

``compact`` writes the findings that are still read as a new generation (findings and resets of their
own) and commits it by one row of ``commits``.  A reader pins the generation that was committed when
it asked; the older one stays whole until ``vacuum``.  Writers are one at a time, as with any
file store; a compaction that fails leaves nothing that is read.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.operators.analyze import analyze, to_payload
from ledgerscope.operators.custody import digest_files, file_sizes
from ledgerscope.schemas import (CASE_SCHEMA, COMMIT_SCHEMA, EVIDENCE_SCHEMA, RESET_SCHEMA,
                                 STORED_FINDING_SCHEMA)
from ledgerscope.session import checkpoint_dir
from ledgerscope.sources.ledger import case_ledger


class CaseStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.paths = {n: f"{self.root}/{n}" for n in ("cases", "evidence", "commits")}

    # ---------------------------------------------------------------- generations
    def generation(self) -> int:
        """The last committed generation of the findings (0: never compacted)."""
        return int(self._read("commits", COMMIT_SCHEMA).agg(F.max("generation")).first()[0] or 0)

    def _generation_path(self, name: str, generation: int) -> str:
        return f"{self.root}/{name}-{generation}" if generation else f"{self.root}/{name}"

    # ---------------------------------------------------------------- readers
    def _read(self, name, schema, path: str | None = None) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path or self.paths[name])
        except Exception as e:  # noqa: BLE001 - an absent table reads as empty
            if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def cases(self) -> DataFrame:
        return self._read("cases", CASE_SCHEMA)

    def evidence(self, case_id: str | None = None) -> DataFrame:
        df = self._read("evidence", EVIDENCE_SCHEMA)
        return df if case_id is None else df.where(F.col("case_id") == case_id)

    def findings(self, case_id: str | None = None, generation: int | None = None) -> DataFrame:
        """Findings saved since their case's last reset, of the last committed generation (or the
        one given, while it is kept)."""
        g = self.generation() if generation is None else generation
        df = self._read("findings", STORED_FINDING_SCHEMA, self._generation_path("findings", g))
        resets = self._read("resets", RESET_SCHEMA, self._generation_path("resets", g))
        if case_id is not None:
            df, resets = df.where(F.col("case_id") == case_id), resets.where(F.col("case_id") == case_id)
        since = resets.groupBy("case_id").agg(F.max("at").alias("_since"))
        return (df.join(since, "case_id", "left")
                .where(F.col("_since").isNull() | (F.col("created_at") >= F.col("_since")))
                .select(*[f.name for f in STORED_FINDING_SCHEMA.fields]))

    # ---------------------------------------------------------------- checks
    def missing_cases(self, df: DataFrame) -> DataFrame:
        known = self.cases().select(F.col("id").alias("case_id"))
        return df.select("case_id").distinct().join(known, "case_id", "left_anti")

    def _require_cases(self, df: DataFrame) -> None:
        missing = [r["case_id"] for r in self.missing_cases(df).limit(5).collect()]
        if missing:
            raise ValueError(f"Case not found: {', '.join(map(str, missing))}")

    # ---------------------------------------------------------------- writers
    def register_cases(self, new: DataFrame) -> DataFrame:
        """``name, description, investigator`` (+ optional ``id``) -> defaults filled,
        appended; returns the stored rows (ids are materialised before the write).  An id that is
        given twice or already stored is a ValueError."""
        checkpoint_dir(self.spark)
        rid = F.col("id") if "id" in new.columns else F.expr("uuid()")
        rows = new.select(
            rid.cast("string").alias("id"), F.col("name").cast("string"),
            (F.col("description") if "description" in new.columns else F.lit(None))
            .cast("string").alias("description"),
            F.col("investigator").cast("string"),
            F.current_timestamp().alias("created_at"),
            (F.col("status") if "status" in new.columns else F.lit("open")).cast("string")
            .alias("status")).checkpoint()
        ids = rows.select("id").unionByName(self.cases().select("id")).groupBy("id").count()
        taken = [r["id"] for r in ids.where(F.col("count") > 1).limit(5).collect()]
        if taken:
            raise ValueError(f"Case ids in use: {', '.join(map(str, taken))}")
        rows.write.mode("append").parquet(self.paths["cases"])
        return rows

    def register_evidence(self, files: DataFrame) -> DataFrame:
        """A3: ``case_id, path, notes`` -> digests of every file, appended; missing case ->
        ValueError, missing file -> FileNotFoundError, unreadable file -> OSError.  ``filename`` is
        the absolute path (a relative one starts from the driver's working folder)."""
        self._require_cases(files)
        checkpoint_dir(self.spark)
        here = F.lit(os.getcwd().rstrip("/") + "/")
        path = F.col("path")
        files = files.withColumn("path", F.when(path.startswith("/") | path.rlike(r"^\w+:"), path)
                                 .otherwise(F.concat(here, path)))
        dig = digest_files(files).checkpoint()
        missing = [r["path"] for r in dig.where(~F.col("exists")).limit(5).collect()]
        if missing:
            raise FileNotFoundError(f"Evidence file not found: {', '.join(missing)}")
        broken = dig.where(F.col("error").isNotNull()).select("path", "error").limit(5).collect()
        if broken:
            raise OSError("Evidence not readable: " + "; ".join(f"{r['path']}: {r['error']}" for r in broken))
        rows = dig.select(
            F.expr("uuid()").alias("id"), "case_id", F.col("path").alias("filename"),
            F.col("sha256").alias("sha256_hash"), F.col("md5").alias("md5_hash"),
            F.col("file_size").cast("long"), "acquired_at",
            F.coalesce(F.col("notes") if "notes" in files.columns else F.lit(""), F.lit(""))
            .alias("notes")).checkpoint()
        rows.write.mode("append").partitionBy("case_id").parquet(self.paths["evidence"])
        return rows

    def _reset(self, cases: DataFrame, micros: int) -> None:
        """Findings of these cases (``case_id``) saved before this time aren't read any more."""
        (cases.select("case_id").distinct().withColumn("at", F.timestamp_micros(F.lit(micros)))
         .write.mode("append").parquet(self._generation_path("resets", self.generation())))

    def save_findings(self, payload: DataFrame, mode: str = "append",
                      cases: DataFrame | None = None) -> int:
        """Store findings (``to_payload`` rows with ``case_id``); returns the count.

        ``mode="append"`` adds rows as the reference does; ``mode="replace"`` takes the place of all
        earlier findings of ``cases`` (column ``case_id``: the cases that were analysed, with or
        without findings; default: the cases in ``payload``).
        """
        if mode not in ("append", "replace"):
            raise ValueError("mode must be 'append' or 'replace'")
        if cases is not None:
            self._require_cases(cases)
        now = time.time_ns() // 1000
        cols = [f.name for f in STORED_FINDING_SCHEMA.fields]
        rows = payload.withColumns({"id": F.expr("uuid()"), "created_at": F.timestamp_micros(F.lit(now))})
        if "amount" not in rows.columns:
            rows = rows.withColumn("amount", F.lit(None).cast("double"))
        rows = rows.select(*[F.col(c).cast(STORED_FINDING_SCHEMA[c].dataType) for c in cols])
        # Materialised once: ids are fixed, the check and the count read the materialised rows.
        # (Not an Observation: once used, it makes the session unserializable for
        # pyspark.ml models that keep a training summary.)
        checkpoint_dir(self.spark)
        rows = rows.checkpoint()
        self._require_cases(rows)
        n = rows.count()
        w = rows.write.partitionBy("case_id")
        if mode == "replace":
            w = w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        else:
            w = w.mode("append")
        w.parquet(self._generation_path("findings", self.generation()))
        if mode == "replace":       # after the new rows: a failure in between loses nothing
            done = rows.select("case_id")
            self._reset(done if cases is None else done.unionByName(cases.select("case_id")), now)
        return int(n)

    def delete_findings(self, case_id: str) -> None:
        """A7 maintenance: drop one case's findings."""
        self._reset(self.spark.createDataFrame([(case_id,)], "case_id string"), time.time_ns() // 1000)

    def compact(self) -> int:
        """Write the live findings as a new generation, without superseded rows and resets and in
        files of a good size, and commit it; returns its number."""
        old = self.generation()
        new = old + 1
        (self.findings(generation=old).hint("rebalance", "case_id").write.mode("overwrite").partitionBy("case_id")
         .parquet(self._generation_path("findings", new)))
        self._read("resets", RESET_SCHEMA, self._generation_path("resets", new)).limit(0).write.mode("overwrite").parquet(
            self._generation_path("resets", new))
        (self.spark.range(1).select(F.lit(new).cast("long").alias("generation"), F.current_timestamp().alias("at"))
         .write.mode("append").parquet(self.paths["commits"]))
        return new

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the generations before the last ``keep`` superseded ones; returns their folders.
        Readers that pinned one of them must have ended."""
        from pyarrow import fs as pafs
        gone = []
        for g in range(self.generation() - keep):
            for name in ("findings", "resets"):
                path = self._generation_path(name, g)
                filesystem, p = pafs.FileSystem.from_uri(path) if "://" in path else (
                    pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"))
                if filesystem.get_file_info(p).type == pafs.FileType.Directory:
                    filesystem.delete_dir(p)
                    gone.append(path)
        return gone

    # ---------------------------------------------------------------- A2
    def ledger_paths(self, case_id: str | None = None, first_only: bool = False,
                     existing: bool = False) -> DataFrame:
        """A2: evidence files ending in .csv (any case) per case; ``first_only`` keeps the
        earliest-acquired one (equal times: the least name), ``existing`` those that are there."""
        ev = self.evidence(case_id).where(F.lower("filename").endswith(".csv"))
        if existing:
            there = file_sizes(ev.select(F.col("filename").alias("path"))).where(F.col("size").isNotNull())
            ev = ev.join(there.select(F.col("path").alias("filename")), "filename", "left_semi")
        if first_only:
            ev = ev.groupBy("case_id").agg(F.min_by("filename", F.struct("acquired_at", "filename"))
                                           .alias("filename"))
        return ev.select("case_id", F.col("filename").alias("path"))

    # ---------------------------------------------------------------- the case pipeline
    def analyze_cases(self) -> int:
        """Every case's CSV evidence, scanned as one ledger with ``case_id``, analysed case by case in
        one job; the findings take the place of all earlier ones of the analysed cases."""
        paths = self.ledger_paths()
        led = case_ledger(self.spark, paths)
        found = analyze(led, by=("case_id",))
        payload = to_payload(found, by=("case_id",))
        return self.save_findings(payload, "replace", paths.select("case_id").distinct())
