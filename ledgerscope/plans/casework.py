"""Registered queries for ML, custody, the case store and report tables.

Queries that write (store, manifests, models) write under the session's shared
checkpoint folder, in a fresh sub-folder per call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerscope.functions.core import written
from ledgerscope.operators import analyze as A
from ledgerscope.operators import custody as K
from ledgerscope.operators import features as FE
from ledgerscope.operators import findings as FD
from ledgerscope.operators import metrics as M
from ledgerscope.operators import ml as ML
from ledgerscope.operators import report as R
from ledgerscope.plans.analytics import CASE, findings_sql, stored
from ledgerscope.plans.catalog import L, register
from ledgerscope.plans.oracle import with_ledger
from ledgerscope.session import checkpoint_dir
from ledgerscope.sources.store import CaseStore

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
KEY = "ledgerscope-demo-key"


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ ML
@register("class_weights", with_ledger("""
SELECT label, CAST(n_class AS BIGINT) AS n_class,
       CAST(SUM(n_class) OVER () AS DOUBLE) / (COUNT(*) OVER () * n_class) AS weight
FROM (SELECT CAST(is_fraud AS INTEGER) AS label, COUNT(*) AS n_class FROM ledger GROUP BY 1)"""))
def q_class_weights(spark, sf_dir):
    f = L(spark, sf_dir).select(F.col("is_fraud").cast("int").alias("label"))
    return ML.class_weights(f)


def _split(spark, sf_dir):
    return ML.stratified_split(FE.labelled_features(L(spark, sf_dir)))


@register("stratified_split")
def q_stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


def _train_eval(spark, sf_dir, kind):
    sp = _split(spark, sf_dir)
    checkpoint_dir(spark)
    sp = sp.checkpoint()
    model = ML.train(sp, kind)
    return M.metrics(ML.score(model, sp.where(F.col("split") == "test"), kind))


@register("train_logistic")
def q_train_logistic(spark, sf_dir):
    return _train_eval(spark, sf_dir, "logistic")


@register("train_random_forest")
def q_train_rf(spark, sf_dir):
    return _train_eval(spark, sf_dir, "random_forest")


@register("train_gbt")
def q_train_gbt(spark, sf_dir):
    return _train_eval(spark, sf_dir, "gbt")


RANK_SQL = """ranked AS (
  SELECT account_id, MAX(score) AS max_fraud_probability, CAST(COUNT(*) AS BIGINT) AS tx_count
  FROM (SELECT sender_id AS account_id, amount / (sender_balance_before + CAST(1.0 AS DOUBLE)) AS score
        FROM ledger
        UNION ALL
        SELECT receiver_id, amount / (sender_balance_before + CAST(1.0 AS DOUBLE)) FROM ledger)
  GROUP BY account_id)"""


def _fixed_score(spark, sf_dir):
    f = FE.features(L(spark, sf_dir))
    return f.withColumn("score", F.col("balance_change_ratio"))


@register("rank_accounts", with_ledger("SELECT * FROM ranked", extra=RANK_SQL))
def q_rank_accounts(spark, sf_dir):
    return ML.rank_accounts(_fixed_score(spark, sf_dir))


@register("rank_top_n", with_ledger(
    "SELECT * FROM ranked ORDER BY max_fraud_probability DESC, account_id LIMIT 20",
    extra=RANK_SQL))
def q_rank_top_n(spark, sf_dir):
    return ML.rank_accounts(_fixed_score(spark, sf_dir), top=20)


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    sp = _split(spark, sf_dir)
    checkpoint_dir(spark)
    sp = sp.checkpoint()
    return ML.feature_importance(ML.train(sp, "random_forest"))


@register("feature_attribution")
def q_feature_attribution(spark, sf_dir):
    sp = _split(spark, sf_dir)
    checkpoint_dir(spark)
    sp = sp.checkpoint()
    model = ML.train(sp, "gbt")
    return ML.attribution(model, sp, n=5000)


@register("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    sp = written(_split(spark, sf_dir))
    model = ML.train(sp, "logistic")
    path = scratch(spark, "model")
    ML.save(model, path)
    again = ML.load(path)
    test = sp.where(F.col("split") == "test")
    a = ML.score(model, test).select("row_id", F.col("score").alias("a"))
    b = ML.score(again, test).select("row_id", F.col("score").alias("b"))
    return a.join(b, "row_id").select("row_id", (F.col("a") == F.col("b")).alias("same"))


# ------------------------------------------------------------------ custody
def _table_files(spark, sf_dir):
    return spark.createDataFrame([(f"{sf_dir}/{t}.parquet", i + 1) for i, t in enumerate(TABLES)],
                                 "path string, seq int")


@register("file_digests")
def q_file_digests(spark, sf_dir):
    return K.digest_files(_table_files(spark, sf_dir)).select(
        "filename", "exists", "sha256", "md5", "file_size")


@register("table_digest")
def q_table_digest(spark, sf_dir):
    led = L(spark, sf_dir).select("row_id.*", "step", "sender_id", "receiver_id", "amount")
    return K.digest_table(led, ["k1", "k2", "k3", "k4", "k5"], label="ledger")


@register("column_digests", """
SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents""")
def q_column_digests(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@register("sign_records")
def q_sign_records(spark, sf_dir):
    s = stored(spark, sf_dir).select("finding_type", "step_start", "step_end", "description",
                                     F.element_at("account_ids", 1).alias("account_id"))
    signed = K.sign_records(s, KEY)
    return K.verify_signatures(signed, KEY, s.columns)


def _manifests(spark, sf_dir):
    files = K.digest_files(_table_files(spark, sf_dir).withColumn("case_id", F.lit(CASE)))
    led = L(spark, sf_dir).select("row_id.*", "step", "amount")
    table = K.digest_table(led, ["k1", "k2", "k3", "k4", "k5"], label="ledger").select(
        F.lit(CASE).alias("case_id"), F.lit(len(TABLES) + 1).alias("seq"), "label", "sha256")
    items = K.manifest_items(files, table)
    cases = spark.createDataFrame([(CASE, "analyst")], "id string, investigator string")
    return items, K.finalize(items, cases)


@register("manifest_hash")
def q_manifest_hash(spark, sf_dir):
    items, _ = _manifests(spark, sf_dir)
    return K.manifest_hash(items)


@register("manifest_verify")
def q_manifest_verify(spark, sf_dir):
    _, man = _manifests(spark, sf_dir)
    path = scratch(spark, "manifest")
    K.write_manifests(man, path)
    return K.verify_manifest(K.read_manifests(spark, path))


@register("report_signature")
def q_report_signature(spark, sf_dir):
    _, man = _manifests(spark, sf_dir)
    return R.report_signature_rows(man, KEY)


@register("report_custody")
def q_report_custody(spark, sf_dir):
    _, man = _manifests(spark, sf_dir)
    return R.report_custody(man)


@register("report_evidence")
def q_report_evidence(spark, sf_dir):
    items, _ = _manifests(spark, sf_dir)
    return R.report_evidence(items)


# ------------------------------------------------------------------ case store
def _store_with_findings(spark, sf_dir, mode="append", times=1):
    store = CaseStore(spark, scratch(spark, "store"))
    store.register_cases(spark.createDataFrame(
        [(CASE, "order ledger", "derived from lineitem and orders", "analyst")],
        "id string, name string, description string, investigator string"))
    store.register_evidence(_table_files(spark, sf_dir).select(
        F.lit(CASE).alias("case_id"), "path", F.lit("driver table").alias("notes")))
    for _ in range(times):
        store.save_findings(stored(spark, sf_dir), mode=mode)
    return store


_STORED_OUT = ("finding_type, severity, description, account_ids, step_start, step_end, "
               "confidence, amount")


@register("findings_sink", findings_sql(f"SELECT case_id, {_STORED_OUT} FROM stored"))
def q_findings_sink(spark, sf_dir):
    store = _store_with_findings(spark, sf_dir)
    return store.findings().select("case_id", *[c.strip() for c in _STORED_OUT.split(",")])


@register("findings_replace", findings_sql(f"SELECT case_id, {_STORED_OUT} FROM stored"))
def q_findings_replace(spark, sf_dir):
    store = _store_with_findings(spark, sf_dir, mode="replace", times=2)
    return store.findings().select("case_id", *[c.strip() for c in _STORED_OUT.split(",")])


@register("case_findings", findings_sql(f"SELECT {_STORED_OUT} FROM stored"))
def q_case_findings(spark, sf_dir):
    store = _store_with_findings(spark, sf_dir)
    return FD.case_findings(store.findings(), CASE).select(
        *[c.strip() for c in _STORED_OUT.split(",")])


@register("case_summary", findings_sql(f"""
SELECT '{CASE}' AS id, 'order ledger' AS name, 'analyst' AS investigator, 'open' AS status,
  CAST({len(TABLES)} AS BIGINT) AS evidence_count, CAST(COUNT(*) AS BIGINT) AS findings_count,
  CAST(COUNT(*) FILTER (WHERE severity = 'high') AS BIGINT) AS high,
  CAST(COUNT(*) FILTER (WHERE severity = 'medium') AS BIGINT) AS medium,
  CAST(COUNT(*) FILTER (WHERE severity = 'low') AS BIGINT) AS low,
  CAST(0 AS BIGINT) AS other
FROM stored"""))
def q_case_summary(spark, sf_dir):
    store = _store_with_findings(spark, sf_dir)
    return FD.case_summary(store.cases(), store.evidence(), store.findings())


@register("case_list", findings_sql(f"""
SELECT '{CASE}' AS id, 'order ledger' AS name, 'analyst' AS investigator, 'open' AS status,
       CAST(COUNT(*) AS BIGINT) AS findings_count FROM stored"""))
def q_case_list(spark, sf_dir):
    store = _store_with_findings(spark, sf_dir)
    return FD.case_list(store.cases().select("id", "name", "investigator", "status"),
                        store.findings())


@register("custody_from_evidence")
def q_custody_from_evidence(spark, sf_dir):
    store = _store_with_findings(spark, sf_dir)
    items = K.custody_from_evidence(store.evidence())
    return K.manifest_hash(items)


# ------------------------------------------------------------------ report tables
@register("report_findings", findings_sql("""
SELECT case_id, rank, upper(severity[1]) || lower(severity[2:]) AS severity, finding_type AS pattern,
  COALESCE(first_account, 'N/A') AS account_id, step_start || '-' || step_end AS steps,
  printf('%.0f%%', confidence * 100) AS confidence, description,
  printf('5. FINDINGS TABLE (Top %d of %d total)', LEAST(100, total), total) AS title
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY sev_rank DESC, confidence DESC,
        amount DESC NULLS LAST, first_account, step_start, step_end, finding_type, description) AS rank,
        COUNT(*) OVER (PARTITION BY case_id) AS total FROM stored)
WHERE rank <= 100"""))
def q_report_findings(spark, sf_dir):
    return R.report_findings(stored(spark, sf_dir))


def q_report_summary(spark, sf_dir):
    led = A.materialized(L(spark, sf_dir), extra=A.TIMELINE_COLUMNS)
    cases = spark.createDataFrame([(CASE,)], "id string")
    return R.report_summary(led, A.to_payload(A.analyze(led, written=True), CASE).checkpoint(), cases)


# ------------------------------------------------------------------ remaining inventory keys
from ledgerscope.operators import detectors as D  # noqa: E402
from ledgerscope.operators import timeline as T  # noqa: E402
from ledgerscope.plans.analytics import (ANNOTATED_SQL, NARRATIVE_SQL, TIMELINE_SQL,  # noqa: E402
                                         TOP_ACCOUNTS_SQL)
from ledgerscope.plans.catalog import LEDGER_OUT, sql_balance, sql_fan  # noqa: E402
from ledgerscope.schemas import TX_TYPES  # noqa: E402
from ledgerscope.plans.analytics import FEATURES_SQL  # noqa: E402
from ledgerscope.sources.ledger import normalize, read_ledger  # noqa: E402
from ledgerscope.sources.tpch import raw_order_log  # noqa: E402


@register("normalize", with_ledger(f"SELECT {', '.join(LEDGER_OUT)} FROM ledger"))
def q_normalize(spark, sf_dir):
    return normalize(raw_order_log(spark, sf_dir)).select(*LEDGER_OUT)


@register("drain_candidates", with_ledger("""
SELECT * FROM (SELECT sender_id, MAX(sender_balance_before) AS max_before,
                      MIN(sender_balance_after) AS min_after, MAX(amount) AS max_amount
               FROM ledger GROUP BY sender_id)
WHERE max_before > 0 AND min_after < CAST(0.1 AS DOUBLE) * max_before AND max_amount > 0"""))
def q_drain_candidates(spark, sf_dir):
    return D.drain_candidates(L(spark, sf_dir))


@register("fan_candidates", with_ledger("""
SELECT account_id, CAST(COUNT(*) AS BIGINT) AS n_counterparties
FROM (SELECT DISTINCT receiver_id AS account_id, sender_id FROM ledger)
GROUP BY account_id HAVING COUNT(*) > 5"""))
def q_fan_candidates(spark, sf_dir):
    return D.fan_candidates(L(spark, sf_dir), role="in")


def _feature(name):
    return with_ledger(f"SELECT k1, k2, k3, k4, k5, {name} FROM feat", extra=FEATURES_SQL)


@register("feat_receiver_prior", _feature("receiver_prior_tx_count"))
def q_feat_receiver_prior(spark, sf_dir):
    return FE.features(L(spark, sf_dir)).select("row_id.*", "receiver_prior_tx_count")


@register("feat_sender_velocity", _feature("sender_tx_velocity"))
def q_feat_sender_velocity(spark, sf_dir):
    return FE.features(L(spark, sf_dir)).select("row_id.*", "sender_tx_velocity")


@register("feat_sender_median", _feature("ROUND(amount_vs_sender_median, 8) AS amount_vs_sender_median"))
def q_feat_sender_median(spark, sf_dir):
    return FE.features(L(spark, sf_dir)).select(
        "row_id.*", F.round("amount_vs_sender_median", 8).alias("amount_vs_sender_median"))


@register("timeline_json")
def q_timeline_json(spark, sf_dir):
    return T.timeline_json(T.timeline(L(spark, sf_dir)))


@register("manifest_items")
def q_manifest_items(spark, sf_dir):
    items, _ = _manifests(spark, sf_dir)
    return items.drop("acquired_at")


@register("manifest_roundtrip")
def q_manifest_roundtrip(spark, sf_dir):
    _, man = _manifests(spark, sf_dir)
    path = scratch(spark, "manifest")
    K.write_manifests(man, path)
    back = K.read_manifests(spark, path)
    return back.select("case_id", "investigator", "manifest_hash", F.size("items").alias("n_items"))


def _nation_cases(spark, sf_dir):
    """One case per nation, led from its region."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").join(
        spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"),
                    F.col("n_name").alias("name"), F.col("n_comment").alias("description") if "n_comment" in n.columns
                    else F.col("n_name").alias("description"), F.col("r_name").alias("investigator"))


_NATION_SQL = """SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS {id}, n_name AS name, r_name AS investigator,
       'open' AS status FROM nation JOIN region ON n_regionkey = r_regionkey"""


@register("case_register", _NATION_SQL.format(id="id"))
def q_case_register(spark, sf_dir):
    """Cases taken from the nations, registered and read back from the store."""
    store = CaseStore(spark, scratch(spark, "store"))
    store.register_cases(_nation_cases(spark, sf_dir))
    return store.cases().select("id", "name", "investigator", "status")


@register("evidence_register")
def q_evidence_register(spark, sf_dir):
    store = _store_with_findings(spark, sf_dir)
    return store.evidence().select("case_id", "filename", "sha256_hash", "md5_hash", "file_size",
                                   "notes")


_TL_OUT = ("case_id, rank, account_id, step, slot, event_type, amount, counterparty, "
           "balance_before, balance_after, annotation, is_flagged")


@register("report_timelines", findings_sql(
    f"SELECT {_TL_OUT} FROM (SELECT a.*, t.case_id, t.rank FROM annotated a "
    "JOIN top_acc t ON t.account_id = a.account_id)",
    extra=TOP_ACCOUNTS_SQL + ",\n" + TIMELINE_SQL + ",\n" + ANNOTATED_SQL))
def q_report_timelines_o(spark, sf_dir):
    led = A.materialized(L(spark, sf_dir), extra=A.TIMELINE_COLUMNS)
    return R.report_timelines(led, A.to_payload(A.analyze(led, written=True), CASE).checkpoint()).select(
        *[c.strip() for c in _TL_OUT.split(",")])


_SUMMARY_SQL = f"""
SELECT '{CASE}' AS case_id,
  printf('The forensic analysis of account %s reveals a sequence of %d transaction events '
         || 'indicative of %s. The suspicious sequence commenced at step %d, marking the start '
         || 'of the detected pattern. Throughout the observed timeline, a total amount of %.2f '
         || 'was moved through the account. ', account_id, n_events, primary_pattern,
         first_suspicious_step, total_amount)
  || CASE WHEN has THEN 'The primary detected mechanism driving this anomaly is classified as '
          || primary_pattern || '.'
     ELSE 'These movements exhibit characteristics consistent with unauthorized or anomalous '
          || 'financial flows.' END AS narrative
FROM narr WHERE account_id = (SELECT account_id FROM top_acc WHERE rank = 1)"""


@register("report_summary", findings_sql(_SUMMARY_SQL, extra=TOP_ACCOUNTS_SQL + ",\n" + TIMELINE_SQL + ",\n" + NARRATIVE_SQL))
def q_report_summary_o(spark, sf_dir):
    return q_report_summary(spark, sf_dir)


@register("report_cover", _NATION_SQL.format(id="case_id"))
def q_report_cover(spark, sf_dir):
    store = CaseStore(spark, scratch(spark, "store"))
    store.register_cases(_nation_cases(spark, sf_dir))
    return R.report_cover(store.cases()).drop("generated_at")


@register("betweenness")
def q_betweenness(spark, sf_dir):
    from ledgerscope.operators import graph as G
    led = L(spark, sf_dir)
    return G.betweenness(G.edges(led), G.vertices(led))


@register("betweenness_estimate")
def q_betweenness_estimate(spark, sf_dir):
    from ledgerscope.operators import graph as G
    led = L(spark, sf_dir)
    return G.betweenness_estimate(G.edges(led), G.vertices(led), error=0.05)


@register("eval_all")
def q_eval_all(spark, sf_dir):
    return ML.evaluate_all(L(spark, sf_dir), scratch(spark, "models"))


# ------------------------------------------------------------------ rows without a party, CSV
_HOLES = """holes AS (
  SELECT * REPLACE (CASE WHEN k2 = 3 AND k3 % 10 = 0 THEN NULL ELSE sender_id END AS sender_id,
                    CASE WHEN k2 = 4 AND k3 % 10 = 1 THEN NULL ELSE receiver_id END AS receiver_id)
  FROM ledger)"""


def _holes(spark, sf_dir):
    """The raw log with some parties missing, by table values."""
    raw = raw_order_log(spark, sf_dir)
    k2, k3 = F.col("row_id.k2"), F.col("row_id.k3") % 10
    return raw.withColumns({
        "nameOrig": F.when(~((k2 == 3) & (k3 == 0)), F.col("nameOrig")),
        "nameDest": F.when(~((k2 == 4) & (k3 == 1)), F.col("nameDest"))})


@register("normalize_nulls", with_ledger(f"SELECT {', '.join(LEDGER_OUT)} FROM holes", extra=_HOLES))
def q_normalize_nulls(spark, sf_dir):
    return normalize(_holes(spark, sf_dir)).select(*LEDGER_OUT)


def _over_holes(sql):
    """A statement over ``ledger`` that reads ``holes`` instead."""
    return with_ledger(sql.replace("FROM ledger", "FROM holes").replace("JOIN ledger", "JOIN holes"), extra=_HOLES)


@register("balance_nulls", _over_holes(sql_balance()))
def q_balance_nulls(spark, sf_dir):
    return D.balance_inconsistency(normalize(_holes(spark, sf_dir)))


@register("fan_out_nulls", _over_holes(sql_fan("out").replace(
    "SELECT DISTINCT sender_id AS acct, step AS s FROM ledger",
    "SELECT DISTINCT sender_id AS acct, step AS s FROM ledger WHERE sender_id IS NOT NULL")))
def q_fan_out_nulls(spark, sf_dir):
    return D.fan_out(normalize(_holes(spark, sf_dir)))


@register("csv_roundtrip", with_ledger(f"SELECT {', '.join(LEDGER_OUT)} FROM ledger"))
def q_csv_roundtrip(spark, sf_dir):
    """A1: the log written as CSV with its columns in another order, read back by header."""
    raw = raw_order_log(spark, sf_dir).drop("row_id")
    path = scratch(spark, "csv")
    raw.select(*sorted(raw.columns, reverse=True)).write.option("header", True).csv(path)
    return read_ledger(spark, path).select(*LEDGER_OUT)


# ------------------------------------------------------------------ several cases that share accounts
def _per_type(final: str, extra: str) -> str:
    """A findings statement for every transaction type as a case of its own."""
    return "\nUNION ALL\n".join(
        f"SELECT * FROM ({findings_sql(final, extra=extra, where=f'tx_type = {chr(39)}{t}{chr(39)}')})".replace(
            f"'{CASE}' AS case_id", f"'{t}' AS case_id") for t in TX_TYPES)


def _typed_ledger(spark, sf_dir):
    return L(spark, sf_dir).withColumn("case_id", F.col("tx_type"))


@register("report_timelines_cases", _per_type(
    f"SELECT {_TL_OUT} FROM (SELECT a.*, t.case_id, t.rank FROM annotated a "
    "JOIN top_acc t ON t.account_id = a.account_id)",
    TOP_ACCOUNTS_SQL + ",\n" + TIMELINE_SQL + ",\n" + ANNOTATED_SQL))
def q_report_timelines_cases(spark, sf_dir):
    led = A.materialized(_typed_ledger(spark, sf_dir), ("case_id",), A.TIMELINE_COLUMNS)
    found = A.to_payload(A.analyze(led, by=("case_id",), written=True), by=("case_id",)).checkpoint()
    return R.report_timelines(led, found).select(*[c.strip() for c in _TL_OUT.split(",")])


@register("report_summary_cases", _per_type(_SUMMARY_SQL,
                                            TOP_ACCOUNTS_SQL + ",\n" + TIMELINE_SQL + ",\n" + NARRATIVE_SQL))
def q_report_summary_cases(spark, sf_dir):
    led = A.materialized(_typed_ledger(spark, sf_dir), ("case_id",), A.TIMELINE_COLUMNS)
    found = A.to_payload(A.analyze(led, by=("case_id",), written=True), by=("case_id",)).checkpoint()
    cases = led.select(F.col("case_id").alias("id")).distinct()
    return R.report_summary(led, found, cases)


def _case_files(spark, sf_dir):
    """``case_id, path``: the log of every transaction type as CSV files of its own."""
    raw = raw_order_log(spark, sf_dir).withColumn("case_id", F.col("type"))
    path = scratch(spark, "case-logs")
    # in row order over the files, as rows of one step keep the order of the log
    raw = raw.repartitionByRange("case_id", "row_id").sortWithinPartitions("case_id", "row_id")
    raw.drop("row_id").write.partitionBy("case_id").option("header", True).csv(path)
    files = spark.read.text(path).inputFiles()
    named = spark.createDataFrame([(f,) for f in files], "path string")
    return named.select(F.regexp_extract("path", "/case_id=([^/]+)/", 1).alias("case_id"), "path")


def _stored_sql() -> str:
    return _per_type(f"SELECT case_id, {_STORED_OUT} FROM stored", "unused AS (SELECT 1)")


@register("case_pipeline", _stored_sql())
def q_case_pipeline(spark, sf_dir):
    """Register cases and their CSV evidence, scan, analyse all cases in one job and store; done twice, as
    the second analysis takes the place of the first."""
    files = _case_files(spark, sf_dir)
    store = CaseStore(spark, scratch(spark, "store"))
    store.register_cases(files.select("case_id").distinct().select(
        F.col("case_id").alias("id"), F.col("case_id").alias("name"), F.lit("analyst").alias("investigator")))
    store.register_evidence(files)
    for _ in range(2):
        store.analyze_cases()
    return store.findings().select("case_id", *[c.strip() for c in _STORED_OUT.split(",")])


@register("findings_replace_empty", _stored_sql().replace(
    "FROM stored)", "FROM stored WHERE case_id <> 'DEBIT')"))
def q_findings_replace_empty(spark, sf_dir):
    """A case that is analysed again without findings has none left."""
    store = CaseStore(spark, scratch(spark, "store"))
    types = spark.createDataFrame([(t,) for t in TX_TYPES], "case_id string")
    store.register_cases(types.select(F.col("case_id").alias("id"), F.col("case_id").alias("name"),
                                      F.lit("analyst").alias("investigator")))
    found = A.to_payload(A.analyze(_typed_ledger(spark, sf_dir), by=("case_id",)), by=("case_id",))
    store.save_findings(found)
    store.save_findings(found.limit(0), "replace", types.where("case_id = 'DEBIT'"))
    return store.findings().select("case_id", *[c.strip() for c in _STORED_OUT.split(",")])


# ------------------------------------------------------------------ custody of the documents, one case per language
def _doc_items(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        F.col("lang").alias("case_id"), F.col("doc_id").alias("seq"), F.lit("file").alias("type"),
        F.concat(F.lit("docs/"), name).alias("filepath"), name.alias("filename"),
        F.octet_length("text").cast("long").alias("file_size"), F.sha2("text", 256).alias("sha256"),
        F.md5("text").alias("md5"), F.lit("2024-01-01").alias("acquired_at"), F.lit("").alias("notes"),
        F.lit(None).cast("string").alias("label"))


def _doc_manifests(spark, sf_dir):
    items = _doc_items(spark, sf_dir)
    cases = items.select(F.col("case_id").alias("id"), F.lit("analyst").alias("investigator")).distinct()
    return K.finalize_rows(items, cases)


_DOC_HASH = """SELECT lang AS case_id, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS manifest_hash,
       CAST(COUNT(*) AS BIGINT) AS n_items FROM documents GROUP BY lang"""


@register("manifest_hash_documents", _DOC_HASH)
def q_manifest_hash_documents(spark, sf_dir):
    return K.manifest_hash(_doc_items(spark, sf_dir))


@register("manifest_roundtrip_documents",
          f"SELECT case_id, 'analyst' AS investigator, manifest_hash, n_items FROM ({_DOC_HASH})")
def q_manifest_roundtrip_documents(spark, sf_dir):
    """Manifests written as JSON and read back with the declared schema; the hash is made again from
    the items read."""
    path = scratch(spark, "manifest")
    K.write_manifest_rows(*_doc_manifests(spark, sf_dir), path)
    back, items = K.read_manifest_rows(spark, path)
    again = K.manifest_hash(items, "pos").withColumnRenamed("case_id", "_id")
    return back.select("case_id", "investigator").join(
        again, F.col("case_id").eqNullSafe(F.col("_id"))).drop("_id")


@register("report_evidence_documents", """
SELECT lang AS case_id, doc_id AS seq, 'file' AS item, doc_id || '.txt' AS filename,
       substring(sha256(text), 1, 16) || '...' AS sha256_trunc, '2024-01-01' AS acquired_at,
       round(strlen(text) / CAST(1048576.0 AS DOUBLE), 2) AS size_mb FROM documents""")
def q_report_evidence_documents(spark, sf_dir):
    return R.report_evidence(_doc_items(spark, sf_dir))


@register("report_custody_documents", f"""
WITH h AS ({_DOC_HASH}),
i AS (SELECT lang AS case_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, doc_id, text FROM documents),
kv AS (
  SELECT case_id, 0 AS seq, 'case_id' AS key, case_id AS value FROM h
  UNION ALL SELECT case_id, 1, 'investigator', 'analyst' FROM h
  UNION ALL SELECT case_id, 3, 'items', 'List of items:' FROM h
  UNION ALL SELECT case_id, 4 + 8 * n_items, 'manifest_hash', manifest_hash FROM h
  UNION ALL SELECT case_id, 4 + 8 * (n - 1) + k.o, '  Item ' || n || ' - ' || k.name,
    CASE k.o WHEN 0 THEN 'file' WHEN 1 THEN 'docs/' || doc_id || '.txt' WHEN 2 THEN doc_id || '.txt'
      WHEN 3 THEN CAST(strlen(text) AS VARCHAR) WHEN 4 THEN sha256(text) WHEN 5 THEN md5(text)
      WHEN 6 THEN '2024-01-01' ELSE '' END
  FROM i, (VALUES (0, 'type'), (1, 'filepath'), (2, 'filename'), (3, 'file_size'), (4, 'sha256'), (5, 'md5'),
                  (6, 'acquired_at'), (7, 'notes')) k(o, name))
SELECT case_id, CAST(seq AS INTEGER) AS seq, key, value FROM kv""")
def q_report_custody_documents(spark, sf_dir):
    rows = R.report_custody_rows(*_doc_manifests(spark, sf_dir)).where(F.col("key") != "finalized_at")
    return rows.withColumn("seq", F.col("seq").cast("int"))


@register("custody_from_evidence_documents", """
SELECT lang AS case_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id % 100, 'd' || doc_id) AS INTEGER) AS seq,
       doc_id || '.txt' AS filename, sha256(text) AS sha256 FROM documents""")
def q_custody_from_evidence_documents(spark, sf_dir):
    items = _doc_items(spark, sf_dir)
    evidence = items.select(
        "case_id", F.concat(F.lit("d"), F.col("seq").cast("string")).alias("id"), F.col("filepath").alias("filename"),
        "file_size", F.col("sha256").alias("sha256_hash"), F.col("md5").alias("md5_hash"),
        F.timestamp_seconds(F.col("seq") % 100).alias("acquired_at"), "notes")
    return K.custody_from_evidence(evidence).select("case_id", "seq", "filename", "sha256")


# ------------------------------------------------------------------ verification of large tables and manifests
# Tampering with the documents (fixed rule): every 97th text is changed, every 101st document removed
# and every 103rd entered once more under a new id.
_TAMPERED_SQL = """t AS (
  SELECT doc_id, CASE WHEN doc_id % 97 = 3 THEN coalesce(text, '') || '!' ELSE text END AS text, lang FROM documents WHERE doc_id % 101 <> 5
  UNION ALL SELECT doc_id + 1000000000, text, lang FROM documents WHERE doc_id % 103 = 7)"""


def _tampered(docs):
    kept = docs.where("doc_id % 101 <> 5").withColumn("text", F.when(
        F.col("doc_id") % 97 == 3, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    return kept.unionByName(docs.where("doc_id % 103 = 7").withColumn("doc_id", F.col("doc_id") + 1_000_000_000))


@register("digest_tree_documents", f"""
WITH {_TAMPERED_SQL}
SELECT coalesce(d.doc_id, t.doc_id) AS doc_id,
       CASE WHEN d.doc_id IS NULL THEN 'added' WHEN t.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM documents d FULL JOIN t ON d.doc_id = t.doc_id
WHERE d.doc_id IS NULL OR t.doc_id IS NULL OR d.text IS DISTINCT FROM t.text""")
def q_digest_tree_documents(spark, sf_dir):
    """The documents' digest tree is stored; a changed table is verified against it."""
    from ledgerscope.operators import digest_tree as DT
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    path = scratch(spark, "digest-tree")
    DT.write_digest_tree(docs, ["doc_id"], path, rows_per_leaf=64)
    return DT.verify_table(_tampered(docs), ["doc_id"], path)


@register("manifest_verify_documents", f"""
WITH {_TAMPERED_SQL}
SELECT lang AS case_id, doc_id || '.txt' AS item FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = d.doc_id AND t.text = d.text)
UNION ALL SELECT DISTINCT lang, 'manifest_hash' FROM documents WHERE lang = 'fr'""")
def q_manifest_verify_documents(spark, sf_dir):
    """Row-form manifests are written, read back and verified against the changed documents; the
    header of one case is forged."""
    path = scratch(spark, "manifest")
    K.write_manifest_rows(*_doc_manifests(spark, sf_dir), path)
    head, items = K.read_manifest_rows(spark, path)
    head = head.withColumn("manifest_hash", F.when(F.col("case_id") == "fr", "0" * 64).otherwise(F.col("manifest_hash")))
    docs = _tampered(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    fresh = docs.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filepath"),
                        F.sha2("text", 256).alias("sha256"))
    return K.verify_manifest_rows(head, items, fresh)


# ------------------------------------------------------------------ A2: the logs of a case
@register("case_ledger_paths", """
WITH t(case_id) AS (SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN 'TRANSFER'
         WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'CASH_IN' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'CASH_OUT'
         WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'DEBIT'
         WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'PAYMENT' END FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT case_id, f.name AS name, f.is_first AS is_first, f.is_there AS is_there FROM t,
  (VALUES ('late.csv', false, true), ('log.CSV', true, true), ('lost.csv', false, false)) f(name, is_first, is_there)
WHERE case_id IS NOT NULL""")
def q_case_ledger_paths(spark, sf_dir):
    """Each transaction type is a case with three logs (one gone since) and a text file; its CSV
    evidence, the earliest of it and what is still there."""
    import os
    cases = raw_order_log(spark, sf_dir).where(F.col("type").isNotNull()).select(F.col("type").alias("case_id")).distinct()
    store = CaseStore(spark, scratch(spark, "store"))
    store.register_cases(cases.select(F.col("case_id").alias("id"), F.col("case_id").alias("name"), F.lit("analyst").alias("investigator")))
    folder = f"{scratch(spark, 'logs').removeprefix('file:')}"
    os.makedirs(folder)
    names = ["log.CSV", "notes.txt", "late.csv", "lost.csv"]
    for n in names:                       # one batch after the other
        with open(f"{folder}/{n}", "w", encoding="utf-8") as f:
            f.write("step\n")
        store.register_evidence(cases.select("case_id", F.lit(f"{folder}/{n}").alias("path")))
    os.rename(f"{folder}/lost.csv", f"{folder}/moved")
    every = store.ledger_paths()
    first = store.ledger_paths(first_only=True).withColumn("is_first", F.lit(True))
    there = store.ledger_paths(existing=True).withColumn("is_there", F.lit(True))
    out = every.join(first, ["case_id", "path"], "left").join(there, ["case_id", "path"], "left")
    return out.select("case_id", F.element_at(F.split("path", "/"), -1).alias("name"),
                      F.coalesce("is_first", F.lit(False)).alias("is_first"), F.coalesce("is_there", F.lit(False)).alias("is_there"))


@register("findings_compact", _stored_sql().replace("FROM stored)", "FROM stored WHERE case_id <> 'DEBIT')"))
def q_findings_compact(spark, sf_dir):
    """Findings saved twice, replaced, deleted for one case and compacted."""
    store = CaseStore(spark, scratch(spark, "store"))
    types = spark.createDataFrame([(t,) for t in TX_TYPES], "case_id string")
    store.register_cases(types.select(F.col("case_id").alias("id"), F.col("case_id").alias("name"),
                                      F.lit("analyst").alias("investigator")))
    found = A.to_payload(A.analyze(_typed_ledger(spark, sf_dir), by=("case_id",)), by=("case_id",)).checkpoint()
    store.save_findings(found)
    store.save_findings(found, "replace")
    store.delete_findings("DEBIT")
    store.compact()
    return store.findings().select("case_id", *[c.strip() for c in _STORED_OUT.split(",")])


# ------------------------------------------------------------------ the SQL surface over a store
_COUNTS_SQL = _per_type("SELECT case_id, COUNT(*) AS n FROM stored GROUP BY case_id", "unused AS (SELECT 1)")


@register("sql_delete_findings", f"""
SELECT t.case_id, CAST(CASE WHEN t.case_id = 'PAYMENT' THEN 0 ELSE coalesce(c.n, 0) END AS BIGINT) AS n_findings, CAST(1 AS BIGINT) AS n_evidence
FROM (VALUES {", ".join(f"('{t}')" for t in TX_TYPES)}) t(case_id) LEFT JOIN ({_COUNTS_SQL}) c USING (case_id)""")
def q_sql_delete_findings(spark, sf_dir):
    """One case's findings are deleted; the store's views, joined in SQL."""
    from ledgerscope.plans import sql_surface as SQL
    store = CaseStore(spark, scratch(spark, "store"))
    types = spark.createDataFrame([(t,) for t in TX_TYPES], "case_id string")
    store.register_cases(types.select(F.col("case_id").alias("id"), F.col("case_id").alias("name"),
                                      F.lit("analyst").alias("investigator")))
    store.register_evidence(types.select("case_id", F.lit(f"{sf_dir}/lineitem.parquet").alias("path")))
    led = _typed_ledger(spark, sf_dir)
    store.save_findings(A.to_payload(A.analyze(led, by=("case_id",)), by=("case_id",)))
    store.delete_findings("PAYMENT")
    SQL.register_store(spark, store)
    return spark.sql(SQL.PER_CASE)


@register("sql_events_of_drained", findings_sql("""
SELECT account_id, CAST(COUNT(*) AS BIGINT) AS n_events, MIN(step) AS first_step, MAX(step) AS last_step FROM events
WHERE account_id IN (SELECT first_account FROM stored WHERE finding_type = 'rapid_drain') GROUP BY account_id""",
                                                extra=TIMELINE_SQL))
def q_sql_events_of_drained(spark, sf_dir):
    from ledgerscope.plans import sql_surface as SQL
    SQL.register_store(spark, _store_with_findings(spark, sf_dir), L(spark, sf_dir))
    return spark.sql(SQL.EVENTS_OF_FLAGGED)
