"""Report datasets N1-N7: the tables behind each section of a case report, for all cases
in one job.  The document layout itself is not built; these are its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.core import global_running_sum
from ledgerscope.operators import findings as FD
from ledgerscope.operators import timeline as T
from ledgerscope.operators.custody import report_signature

# Fallback summaries (fixed values).
NO_FINDINGS = "No findings were recorded for this case."
NO_LEDGER = ("Timeline data could not be reconstructed because no CSV evidence is registered "
             "for this case.")
NO_ACCOUNT = "The findings of this case name no account with recorded transactions."


def report_cover(cases: DataFrame) -> DataFrame:
    """One cover row per case."""
    return cases.select(F.col("id").alias("case_id"), "name", "investigator", "status",
                        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss 'UTC'")
                        .alias("generated_at"))


def report_findings(findings: DataFrame, n: int = 100) -> DataFrame:
    """The top-n findings table with display columns, and the shown/total title."""
    top = FD.top_findings(findings, n)
    title = F.format_string("5. FINDINGS TABLE (Top %d of %d total)",
                            F.least(F.lit(n), F.col("total")), F.col("total"))
    return top.select(
        "case_id", "rank",
        F.initcap(F.lower(F.coalesce("severity", F.lit("low")))).alias("severity"),
        F.col("finding_type").alias("pattern"),
        F.coalesce(F.col("first_account"), F.lit("N/A")).alias("account_id"),
        F.concat_ws("-", F.col("step_start").cast("string"), F.col("step_end").cast("string"))
        .alias("steps"),
        F.format_string("%.0f%%", F.col("confidence") * 100).alias("confidence"),
        "description", title.alias("title"))


def _case_events(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Events of the listed accounts (``case_id, account_id``), each under its case.  A ledger with
    ``case_id`` gives a case only its own rows; one without serves every case."""
    if "case_id" in ledger.columns:
        return T.timeline(ledger, accounts, by=("case_id",))
    events = T.timeline(ledger, accounts)
    return accounts.select("case_id", "account_id").join(events, "account_id").select(
        "case_id", *events.columns)


def _named(findings: DataFrame, accounts: DataFrame) -> DataFrame:
    keys = ["case_id", "account_id"]
    return (FD.finding_accounts(findings).select(*keys, "finding_type", "step_start", "step_end")
            .join(accounts.select(*keys), keys, "left_semi"))


def account_timelines(ledger: DataFrame, findings: DataFrame, accounts: DataFrame) -> DataFrame:
    """Annotated timelines of the listed accounts (``case_id, account_id, rank``), each
    annotated with its own case's findings that name the account."""
    ann = T.annotate(_case_events(ledger, accounts), _named(findings, accounts), by=("case_id",))
    return ann.join(accounts.select("case_id", "account_id", "rank"), ["case_id", "account_id"])


def report_timelines(ledger: DataFrame, findings: DataFrame, n_accounts: int = 5) -> DataFrame:
    """Timelines of the top accounts (S2) in report order."""
    top = F.broadcast(FD.top_accounts(findings, n_accounts))          # a few rows per case
    return account_timelines(ledger, findings, top).select(
        "case_id", "rank", "account_id", "step", "row_id", "slot", "event_type", "amount",
        "counterparty", "balance_before", "balance_after", "annotation", "is_flagged")


def report_summary(ledger: DataFrame | None, findings: DataFrame, cases: DataFrame,
                   n_accounts: int = 5) -> DataFrame:
    """The narrative of the first top account that has events in its case's ledger; fallbacks
    when the case has no findings, no ledger or no such account."""
    ids = cases.select(F.col("id").alias("case_id")).join(
        findings.select("case_id").distinct().withColumn("_has", F.lit(True)), "case_id", "left")
    if ledger is None:
        return ids.select("case_id", F.when(F.col("_has"), F.lit(NO_LEDGER))
                          .otherwise(F.lit(NO_FINDINGS)).alias("narrative"))
    top = F.broadcast(FD.top_accounts(findings, n_accounts))          # a few rows per case
    nar = T.narratives(_case_events(ledger, top), _named(findings, top), by=("case_id",))
    first = (top.join(nar, ["case_id", "account_id"]).groupBy("case_id")
             .agg(F.min_by("narrative", "rank").alias("narrative")))
    return ids.join(first, "case_id", "left").select("case_id", F.coalesce(
        "narrative", F.when(F.col("_has"), F.lit(NO_ACCOUNT)).otherwise(F.lit(NO_FINDINGS)))
        .alias("narrative"))


def report_evidence(items: DataFrame) -> DataFrame:
    """Evidence integrity rows: type (default ``Item n``), filename or label,
    SHA-256 cut to 16 characters + ``...``, acquired_at."""
    sha = F.coalesce("sha256", F.lit(""))
    return items.select(
        "case_id", "seq",
        F.coalesce("type", F.format_string("Item %d", F.col("seq"))).alias("item"),
        F.coalesce("filename", "label", F.lit("N/A")).alias("filename"),
        F.when(F.length(sha) > 16, F.concat(F.substring(sha, 1, 16), F.lit("..."))).otherwise(sha)
        .alias("sha256_trunc"),
        F.coalesce("acquired_at", F.lit("N/A")).alias("acquired_at"),
        F.round(F.col("file_size") / F.lit(1048576.0), 2).alias("size_mb"))


# Order of manifest keys and item keys in the custody appendix (fixed values).
MANIFEST_KEYS = ["case_id", "investigator", "finalized_at", "items", "manifest_hash"]
ITEM_KEYS = ["type", "filepath", "filename", "file_size", "sha256", "md5", "acquired_at", "notes",
             "label"]


def report_custody(manifests: DataFrame) -> DataFrame:
    """The chain-of-custody key/value rows (``case_id, seq, key, value``): header keys,
    a ``List of items:`` marker, then ``  Item i - key`` rows for the keys that an item has."""
    head_before = [F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"))
                   for k in MANIFEST_KEYS[:3]]
    marker = F.struct(F.lit("items").alias("key"), F.lit("List of items:").alias("value"))
    tail = F.struct(F.lit("manifest_hash").alias("key"),
                    F.col("manifest_hash").cast("string").alias("value"))
    item_rows = F.flatten(F.transform(
        F.coalesce(F.col("items"), F.array()), lambda it, i: F.filter(F.array(*[
            F.struct(F.format_string("  Item %d - %s", i + 1, F.lit(k)).alias("key"),
                     it[k].cast("string").alias("value")) for k in ITEM_KEYS]),
            lambda kv: kv["value"].isNotNull())))
    rows = F.concat(F.array(*head_before, marker), item_rows, F.array(tail))
    return manifests.select("case_id", F.posexplode(rows).alias("seq", "kv")).select(
        "case_id", "seq", F.col("kv.key").alias("key"),
        F.coalesce(F.col("kv.value"), F.lit("None")).alias("value"))


def report_custody_rows(head: DataFrame, items: DataFrame) -> DataFrame:
    """N6 of the header and item rows of ``custody.finalize_rows``: the rows of ``report_custody``,
    made item by item and numbered by a running sum."""
    kv = F.filter(F.array(*[
        F.struct(F.format_string("  Item %d - %s", F.col("pos") + 1, F.lit(k)).alias("key"),
                 F.col(k).cast("string").alias("value")) for k in ITEM_KEYS]),
        lambda x: x["value"].isNotNull())
    rows = items.select("case_id", kv.alias("kv"), F.struct("case_id", "pos").alias("_k"))
    rows = global_running_sum(rows.withColumn("n", F.size("kv").cast("long")), "_k", ["n"], prefix="to_")
    per = rows.groupBy(F.col("case_id").alias("_case")).agg(
        F.min(F.col("to_n") - F.col("n")).alias("_before"), F.sum("n").alias("_n"))
    same = F.col("case_id").eqNullSafe(F.col("_case"))
    made = rows.join(per, same).select(
        "case_id", (4 + F.col("to_n") - F.col("n") - F.col("_before")).alias("_at"),
        F.posexplode("kv").alias("_i", "kv")).select(
        "case_id", (F.col("_at") + F.col("_i")).alias("seq"), "kv.key", "kv.value")
    top = [F.struct(F.lit(i).cast("long").alias("seq"), F.lit(k).alias("key"),
                    F.col(k).cast("string").alias("value")) for i, k in enumerate(MANIFEST_KEYS[:3])]
    top.append(F.struct(F.lit(3).cast("long").alias("seq"), F.lit("items").alias("key"),
                        F.lit("List of items:").alias("value")))
    top.append(F.struct((4 + F.coalesce("_n", F.lit(0))).cast("long").alias("seq"),
                        F.lit("manifest_hash").alias("key"), F.col("manifest_hash").alias("value")))
    heads = head.join(per, same, "left").select("case_id", F.explode(F.array(*top)).alias("x")).select(
        "case_id", "x.seq", "x.key", F.coalesce("x.value", F.lit("None")).alias("value"))
    return heads.unionByName(made)


def report_signature_rows(manifests: DataFrame, key: str) -> DataFrame:
    """N7."""
    return report_signature(manifests, key)


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One table per report section under ``path/<section>``."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/{name}")


def report_tables(ledger, findings, cases, manifests, items, key: str) -> dict[str, DataFrame]:
    """All report sections as DataFrames."""
    return {
        "cover": report_cover(cases),
        "summary": report_summary(ledger, findings, cases),
        "evidence": report_evidence(items),
        "findings": report_findings(findings),
        "timelines": report_timelines(ledger, findings),
        "custody": report_custody(manifests),
        "signature": report_signature_rows(manifests, key),
    }


__all__ = ["report_cover", "report_findings", "report_timelines", "report_summary",
           "report_evidence", "report_custody", "report_custody_rows", "report_signature_rows", "report_tables",
           "account_timelines", "write_report"]
