"""Registered queries over findings, timelines, the graph, features and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.functions.core import written
from ledgerscope.operators import analyze as A
from ledgerscope.operators import detectors as D
from ledgerscope.operators import features as FE
from ledgerscope.operators import findings as FD
from ledgerscope.operators import graph as G
from ledgerscope.operators import metrics as M
from ledgerscope.operators import timeline as T
from ledgerscope.plans.catalog import (DR_CTE, FINDING_SQL, MEDIAN_CTE, L, register, sql_balance,
                                       sql_dormant, sql_fan, sql_rapid_drain, sql_round_trip)
from ledgerscope.plans.oracle import MONEY, ORDER, with_ledger
from ledgerscope.session import checkpoint_dir

CASE = "case-1"


def findings_sql(final: str, dense: bool = False, extra: str = "", where: str | None = None) -> str:
    """WITH ledger, detector CTEs, ``findings`` (analyze + seq), ``stored`` (payload)."""
    parts = [sql_rapid_drain(), sql_round_trip(), sql_fan("out"), sql_fan("in"), sql_dormant(),
             sql_balance()]
    union = "\nUNION ALL\n".join(f"SELECT {FINDING_SQL}, {i} AS detector_seq FROM ({s})"
                                 for i, s in enumerate(parts))
    stored = f"""stored AS (
  SELECT '{CASE}' AS case_id, pattern AS finding_type,
         CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.75 THEN 'medium'
              ELSE 'low' END AS severity,
         description, [account_id] AS account_ids, step_start, step_end, confidence, amount,
         account_id AS first_account,
         CASE WHEN confidence >= 0.9 THEN 3 WHEN confidence >= 0.75 THEN 2 ELSE 1 END AS sev_rank
  FROM findings)"""
    ctes = DR_CTE + ",\n" + MEDIAN_CTE + f",\nfindings AS ({union}),\n" + stored
    if extra:
        ctes += ",\n" + extra
    return with_ledger(final, dense, extra=ctes, where=where)


def stored(spark, sf_dir, dense=False):
    """The findings of the ledger as they are stored, written once: reports read them several times."""
    checkpoint_dir(spark)
    return A.to_payload(A.analyze(L(spark, sf_dir, dense)), CASE).checkpoint()


# ------------------------------------------------------------------ findings analytics
@register("pattern_counts", findings_sql(
    "SELECT case_id, finding_type, CAST(COUNT(*) AS BIGINT) AS count FROM stored "
    "GROUP BY case_id, finding_type"))
def q_pattern_counts(spark, sf_dir):
    return FD.pattern_counts(stored(spark, sf_dir))


@register("findings_breakdown", findings_sql("""
SELECT case_id, finding_type, count, avg_confidence,
       ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY is_total, count DESC, finding_type) AS ord
FROM (
  SELECT case_id, finding_type, CAST(COUNT(*) AS BIGINT) AS count,
         ROUND(AVG(confidence), 2) AS avg_confidence, 0 AS is_total
  FROM stored GROUP BY case_id, finding_type
  UNION ALL
  SELECT case_id, 'TOTAL', CAST(COUNT(*) AS BIGINT), CAST(NULL AS DOUBLE), 1
  FROM stored GROUP BY case_id)"""))
def q_findings_breakdown(spark, sf_dir):
    return FD.findings_breakdown(stored(spark, sf_dir))


_TOP_ORDER = ("sev_rank DESC, confidence DESC, amount DESC NULLS LAST, first_account, step_start, "
              "step_end, finding_type, description")
_TOP_COLS = ("case_id, finding_type, severity, description, account_ids, step_start, step_end, "
             "confidence, amount, first_account, rank, total")


@register("top_findings", findings_sql(f"""
SELECT {_TOP_COLS} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY {_TOP_ORDER}) AS rank,
         COUNT(*) OVER (PARTITION BY case_id) AS total
  FROM stored) WHERE rank <= 100"""))
def q_top_findings(spark, sf_dir):
    return FD.top_findings(stored(spark, sf_dir), 100).select(*[c.strip() for c in
                                                              _TOP_COLS.split(",")])


TOP_ACCOUNTS_SQL = """top_acc AS (
  SELECT case_id, account_id, rank FROM (
    SELECT case_id, account_id, ROW_NUMBER() OVER (PARTITION BY case_id
             ORDER BY sr DESC, cf DESC, am DESC, account_id, ss) AS rank
    FROM (SELECT case_id, first_account AS account_id,
                 arg_max(sev_rank, (sev_rank, confidence, COALESCE(amount, '-inf'::DOUBLE), -step_start)) AS sr,
                 arg_max(confidence, (sev_rank, confidence, COALESCE(amount, '-inf'::DOUBLE), -step_start)) AS cf,
                 arg_max(COALESCE(amount, '-inf'::DOUBLE), (sev_rank, confidence, COALESCE(amount, '-inf'::DOUBLE), -step_start)) AS am,
                 arg_max(step_start, (sev_rank, confidence, COALESCE(amount, '-inf'::DOUBLE), -step_start)) AS ss
          FROM stored WHERE first_account <> 'DATASET' GROUP BY case_id, first_account))
  WHERE rank <= 5)"""


@register("top_accounts", findings_sql("SELECT case_id, account_id, rank FROM top_acc",
                                       extra=TOP_ACCOUNTS_SQL))
def q_top_accounts(spark, sf_dir):
    return FD.top_accounts(stored(spark, sf_dir), 5)


@register("findings_for_account", findings_sql(
    "SELECT finding_type, step_start, step_end, amount FROM stored "
    "WHERE list_contains(account_ids, 'S1')"))
def q_findings_for_account(spark, sf_dir):
    return FD.findings_for_account(stored(spark, sf_dir), "S1").select(
        "finding_type", "step_start", "step_end", "amount")


@register("first_account_of_pattern", findings_sql(
    "SELECT account_ids[1] AS account_id FROM stored WHERE finding_type = 'rapid_drain' "
    "ORDER BY step_start, account_ids[1] LIMIT 1"))
def q_first_account(spark, sf_dir):
    return FD.first_account_of_pattern(stored(spark, sf_dir), "rapid_drain")


@register("detection_rate", findings_sql("""
SELECT fraud_rows, hits, CAST(hits AS DOUBLE) / fraud_rows AS rate FROM
 (SELECT CAST(COUNT(*) AS BIGINT) AS fraud_rows FROM ledger WHERE is_fraud),
 (SELECT CAST(COUNT(*) AS BIGINT) AS hits FROM ledger l WHERE is_fraud AND EXISTS (
     SELECT 1 FROM stored s WHERE s.finding_type <> 'balance_inconsistency'
       AND (list_contains(s.account_ids, l.sender_id) OR list_contains(s.account_ids, l.receiver_id))
       AND l.step BETWEEN s.step_start AND s.step_end))"""))
def q_detection_rate(spark, sf_dir):
    led = A.materialized(L(spark, sf_dir), extra=("is_fraud",))      # read again for the fraud rows
    return FD.detection_rate(led, A.to_payload(A.analyze(led, written=True), CASE))


# ------------------------------------------------------------------ timeline
TIMELINE_SQL = """events AS (
  SELECT sender_id AS account_id, step, k1, k2, k3, k4, k5, 0 AS slot,
         COALESCE(tx_type, 'nan') || '_SENDER' AS event_type, amount, receiver_id AS counterparty,
         sender_balance_before AS balance_before, sender_balance_after AS balance_after,
         COALESCE(is_flagged, false) AS is_flagged
  FROM ledger
  UNION ALL
  SELECT receiver_id, step, k1, k2, k3, k4, k5, 1, COALESCE(tx_type, 'nan') || '_RECEIVER', amount,
         sender_id, receiver_balance_before, receiver_balance_after, COALESCE(is_flagged, false)
  FROM ledger WHERE receiver_id <> sender_id)"""
_EV_COLS = ("account_id, step, event_type, amount, counterparty, balance_before, balance_after, "
            "annotation, is_flagged")


@register("timeline", with_ledger(f"SELECT {_EV_COLS} FROM (SELECT *, '' AS annotation FROM events)",
                                  extra=TIMELINE_SQL))
def q_timeline(spark, sf_dir):
    return T.timeline(L(spark, sf_dir)).select(*[c.strip() for c in _EV_COLS.split(",")])


ANNOTATED_SQL = """annotated AS (
  SELECT e.*, concat_ws(' ',
      CASE WHEN EXISTS (SELECT 1 FROM findings f WHERE f.pattern = 'rapid_drain'
             AND f.account_id = e.account_id AND e.step BETWEEN f.step_start AND f.step_end)
           THEN '[RAPID DRAIN]' END,
      CASE WHEN EXISTS (SELECT 1 FROM findings f WHERE f.pattern = 'dormant_activation'
             AND f.account_id = e.account_id AND e.step BETWEEN f.step_start AND f.step_end)
           THEN '[DORMANT ACTIVATION]' END,
      CASE WHEN e.balance_after < CAST(0.01 AS DOUBLE) * e.balance_before THEN '[ACCOUNT DRAINED]' END,
      CASE WHEN contains(e.event_type, 'TRANSFER') AND e.is_flagged THEN '[FLAGGED BY PAYSIM]' END
    ) AS annotation
  FROM events e)"""


@register("timeline_annotated", findings_sql(f"SELECT {_EV_COLS} FROM annotated",
                                             extra=TIMELINE_SQL + ",\n" + ANNOTATED_SQL))
def q_timeline_annotated(spark, sf_dir):
    led = A.materialized(L(spark, sf_dir), extra=A.TIMELINE_COLUMNS)
    return T.annotate(T.timeline(led), A.analyze(led, written=True)).select(
        *[c.strip() for c in _EV_COLS.split(",")])


NARRATIVE_SQL = """narr AS (
  SELECT p.account_id, p.n_events, p.total_amount,
    CASE WHEN ff.pattern IS NOT NULL THEN replace(ff.pattern, '_', ' ')
         WHEN p.first_flagged IS NOT NULL THEN 'flagged transactions'
         ELSE 'suspicious activity' END AS primary_pattern,
    CASE WHEN ff.pattern IS NOT NULL THEN ff.step_start
         ELSE COALESCE(p.first_flagged, p.first_step) END AS first_suspicious_step,
    ff.pattern IS NOT NULL AS has
  FROM (SELECT account_id, CAST(COUNT(*) AS BIGINT) AS n_events,
               CAST(SUM(CAST(amount AS DECIMAL(38,6))) AS DOUBLE) AS total_amount,
               MIN(step) AS first_step, MIN(CASE WHEN is_flagged THEN step END) AS first_flagged
        FROM events GROUP BY account_id) p
  LEFT JOIN (SELECT account_id, pattern, step_start FROM (
               SELECT account_id, pattern, step_start, ROW_NUMBER() OVER (
                 PARTITION BY account_id ORDER BY step_start, detector_seq, pattern) AS r
               FROM findings) WHERE r = 1) ff ON ff.account_id = p.account_id)"""


@register("narrative", findings_sql("""
SELECT account_id, n_events, total_amount, primary_pattern, first_suspicious_step,
  printf('The forensic analysis of account %s reveals a sequence of %d transaction events '
         || 'indicative of %s. The suspicious sequence commenced at step %d, marking the start '
         || 'of the detected pattern. Throughout the observed timeline, a total amount of %.2f '
         || 'was moved through the account. ', account_id, n_events, primary_pattern,
         first_suspicious_step, total_amount)
  || CASE WHEN has THEN 'The primary detected mechanism driving this anomaly is classified as '
          || primary_pattern || '.'
     ELSE 'These movements exhibit characteristics consistent with unauthorized or anomalous '
          || 'financial flows.' END AS narrative
FROM narr""", extra=TIMELINE_SQL + ",\n" + NARRATIVE_SQL))
def q_narrative(spark, sf_dir):
    led = L(spark, sf_dir)
    return T.narratives(T.timeline(led), A.analyze(led).checkpoint())


# ------------------------------------------------------------------ graph
@register("graph_vertices", with_ledger(f"""
SELECT account_id,
  CAST(COALESCE(SUM(CAST(amount AS {MONEY})) FILTER (WHERE slot = 0), 0) AS DOUBLE) AS total_sent,
  CAST(COALESCE(SUM(CAST(amount AS {MONEY})) FILTER (WHERE slot = 1), 0) AS DOUBLE) AS total_received,
  CAST(COUNT(*) AS BIGINT) AS tx_count, bool_or(f) AS is_flagged
FROM (SELECT sender_id AS account_id, 0 AS slot, amount, COALESCE(is_flagged, false) AS f FROM ledger
      UNION ALL SELECT receiver_id, 1, amount, COALESCE(is_flagged, false) FROM ledger)
GROUP BY account_id"""))
def q_graph_vertices(spark, sf_dir):
    return G.vertices(L(spark, sf_dir))


EDGES_SQL = """edges AS (
  SELECT sender_id, receiver_id, amount, step, tx_type FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY sender_id, receiver_id
                                 ORDER BY k1 DESC, k2 DESC, k3 DESC, k4 DESC, k5 DESC) AS r
    FROM ledger) WHERE r = 1)"""


@register("graph_edges", with_ledger("SELECT * FROM edges", extra=EDGES_SQL))
def q_graph_edges(spark, sf_dir):
    return G.edges(L(spark, sf_dir))


@register("degree_centrality", with_ledger("""
SELECT v.account_id, CAST(COALESCE(i.c, 0) AS BIGINT) AS in_deg, CAST(COALESCE(o.c, 0) AS BIGINT) AS out_deg,
  CASE WHEN n.n <= 1 THEN 1.0 ELSE CAST(COALESCE(i.c, 0) + COALESCE(o.c, 0) AS DOUBLE) / (n.n - 1) END AS degree,
  CASE WHEN n.n <= 1 THEN 1.0 ELSE CAST(COALESCE(i.c, 0) AS DOUBLE) / (n.n - 1) END AS in_degree,
  CASE WHEN n.n <= 1 THEN 1.0 ELSE CAST(COALESCE(o.c, 0) AS DOUBLE) / (n.n - 1) END AS out_degree
FROM (SELECT DISTINCT sender_id AS account_id FROM ledger UNION SELECT receiver_id FROM ledger) v
LEFT JOIN (SELECT receiver_id AS account_id, COUNT(*) AS c FROM edges GROUP BY 1) i USING (account_id)
LEFT JOIN (SELECT sender_id AS account_id, COUNT(*) AS c FROM edges GROUP BY 1) o USING (account_id),
(SELECT COUNT(*) AS n FROM (SELECT sender_id FROM ledger UNION SELECT receiver_id FROM ledger)) n""",
                                            extra=EDGES_SQL))
def q_degree_centrality(spark, sf_dir):
    led = L(spark, sf_dir)
    return G.degree_centrality(G.vertices(led), G.edges(led))


EGO_SQL = """adj AS (SELECT sender_id AS node, receiver_id AS nbr FROM ledger
                UNION SELECT receiver_id, sender_id FROM ledger),
seeds AS (SELECT DISTINCT account_id FROM (
  SELECT account_id, SUM(c) OVER (PARTITION BY account_id ORDER BY step
                                  RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS w
  FROM (SELECT account_id, step, COUNT(*) AS c FROM (
          SELECT sender_id AS account_id, step FROM ledger
          UNION ALL SELECT receiver_id, step FROM ledger) GROUP BY account_id, step)
) WHERE w > 8),
d1 AS (SELECT DISTINCT s.account_id AS seed, a.nbr AS node FROM seeds s JOIN adj a ON a.node = s.account_id),
d2 AS (SELECT DISTINCT d1.seed, a.nbr AS node FROM d1 JOIN adj a ON a.node = d1.node),
ego AS (SELECT seed, node, CAST(MIN(dist) AS BIGINT) AS dist FROM (
  SELECT account_id AS seed, account_id AS node, 0 AS dist FROM seeds
  UNION ALL SELECT seed, node, 1 FROM d1 UNION ALL SELECT seed, node, 2 FROM d2)
  GROUP BY seed, node)"""


def _ego(spark, sf_dir):
    led = L(spark, sf_dir)
    return led, G.ego_nodes(G.edges(led), D.high_velocity(led), depth=2)


@register("ego_network", with_ledger("SELECT seed, node, dist FROM ego", extra=EGO_SQL))
def q_ego_network(spark, sf_dir):
    _, nodes = _ego(spark, sf_dir)
    return nodes.select("seed", "node", F.col("dist").cast("long").alias("dist"))


@register("ego_network_edges", with_ledger("""
SELECT e.* FROM (SELECT g.seed, x.sender_id, x.receiver_id, x.amount, x.step, x.tx_type
                 FROM ego g JOIN edges x ON x.sender_id = g.node) e
JOIN ego h ON h.seed = e.seed AND h.node = e.receiver_id""", extra=EGO_SQL + ",\n" + EDGES_SQL))
def q_ego_edges(spark, sf_dir):
    led, nodes = _ego(spark, sf_dir)
    return G.ego_edges(G.edges(led), nodes)


@register("ego_network_styled", with_ledger("""
SELECT g.seed, g.node, CASE WHEN COALESCE(v.f, false) THEN 'red' ELSE 'steelblue' END AS color
FROM ego g LEFT JOIN (SELECT account_id, bool_or(f) AS f FROM (
    SELECT sender_id AS account_id, COALESCE(is_flagged, false) AS f FROM ledger
    UNION ALL SELECT receiver_id, COALESCE(is_flagged, false) FROM ledger) GROUP BY 1) v
  ON v.account_id = g.node""", extra=EGO_SQL))
def q_ego_styled(spark, sf_dir):
    led = L(spark, sf_dir)
    nodes, edge_df = G.ego_network(G.edges(led), G.vertices(led), D.high_velocity(led))
    styled_nodes, _ = G.styled(nodes, edge_df)
    return styled_nodes.select("seed", "node", "color")


@register("edge_weights", with_ledger("""
SELECT sender_id, receiver_id,
  ROUND(CASE WHEN COALESCE(amount, 1.0) > 1 THEN ln(COALESCE(amount, 1.0)) ELSE 0.5 END, 9) AS edge_width
FROM edges""", extra=EDGES_SQL))
def q_edge_weights(spark, sf_dir):
    _, styled_edges = G.styled(G.vertices(L(spark, sf_dir)), G.edges(L(spark, sf_dir)))
    return styled_edges.select("sender_id", "receiver_id",
                               F.round("edge_width", 9).alias("edge_width"))


# ------------------------------------------------------------------ features and metrics
FEATURES_SQL = f"""feat AS (
  SELECT k1, k2, k3, k4, k5, step, sender_id, receiver_id, is_fraud,
    amount,
    CAST(COALESCE(tx_type = 'CASH_IN', false) AS DOUBLE) AS tx_type_CASH_IN,
    CAST(COALESCE(tx_type = 'CASH_OUT', false) AS DOUBLE) AS tx_type_CASH_OUT,
    CAST(COALESCE(tx_type = 'DEBIT', false) AS DOUBLE) AS tx_type_DEBIT,
    CAST(COALESCE(tx_type = 'PAYMENT', false) AS DOUBLE) AS tx_type_PAYMENT,
    CAST(COALESCE(tx_type = 'TRANSFER', false) AS DOUBLE) AS tx_type_TRANSFER,
    amount / (sender_balance_before + CAST(1.0 AS DOUBLE)) AS balance_change_ratio,
    CAST(COALESCE(sender_balance_after < CAST(0.1 AS DOUBLE) * sender_balance_before, false) AS DOUBLE)
      AS sender_drained,
    CAST(COALESCE(abs(sender_balance_before - amount - sender_balance_after) > CAST(0.01 AS DOUBLE),
                  false) AS DOUBLE) AS balance_mismatch,
    CAST(ROW_NUMBER() OVER (PARTITION BY receiver_id ORDER BY {ORDER}) - 1 AS DOUBLE)
      AS receiver_prior_tx_count,
    CAST(COUNT(*) OVER (PARTITION BY sender_id ORDER BY step
                        RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS sender_tx_velocity,
    amount / (COALESCE(median(amount) OVER (PARTITION BY sender_id ORDER BY {ORDER}
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)
              + CAST(1.0 AS DOUBLE)) AS amount_vs_sender_median,
    CAST(step % 24 AS DOUBLE) AS hour_of_day
  FROM ledger)"""


@register("features", with_ledger("""
SELECT k1, k2, k3, k4, k5, amount, tx_type_CASH_IN, tx_type_CASH_OUT, tx_type_DEBIT, tx_type_PAYMENT,
  tx_type_TRANSFER, balance_change_ratio, sender_drained, balance_mismatch, receiver_prior_tx_count,
  sender_tx_velocity, ROUND(amount_vs_sender_median, 8) AS amount_vs_sender_median, hour_of_day
FROM feat""", extra=FEATURES_SQL))
def q_features(spark, sf_dir):
    f = FE.features(L(spark, sf_dir))
    return f.select("row_id.k1", "row_id.k2", "row_id.k3", "row_id.k4", "row_id.k5",
                    *[F.round(c, 8).alias(c) if c == "amount_vs_sender_median" else F.col(c)
                      for c in FE.FEATURE_COLUMNS])


SCORED_SQL = """scored AS (
  SELECT 'balance_change_ratio' AS model, balance_change_ratio AS score,
         CAST(is_fraud AS INTEGER) AS label FROM feat
  UNION ALL
  SELECT 'hour_of_day', hour_of_day, CAST(is_fraud AS INTEGER) FROM feat),
per AS (SELECT model, score, COUNT(*) FILTER (WHERE label = 1) AS pos,
               COUNT(*) FILTER (WHERE label <> 1) AS neg
        FROM scored WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY model, score),
curve0 AS (
  SELECT model, score, pos, neg,
    SUM(pos) OVER (PARTITION BY model) AS P, SUM(neg) OVER (PARTITION BY model) AS N,
    SUM(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
    SUM(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp
  FROM per),
curve1 AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN P > 0 THEN CAST(tp AS DOUBLE) / P ELSE 1.0 END AS recall
  FROM curve0),
curve AS (
  SELECT *, CASE WHEN precision + recall <> 0
                 THEN CAST(2.0 AS DOUBLE) * (precision * recall) / (precision + recall)
                 ELSE 0.0 END AS f1
  FROM curve1)"""


def _scored(spark, sf_dir):
    # both deterministic "models" from one pass over the features
    f = FE.labelled_features(L(spark, sf_dir))
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score"))
                       for m in ("balance_change_ratio", "hour_of_day")])
    return f.select("label", F.explode(models).alias("m")).select("m.model", "m.score", "label")


@register("pr_curve", with_ledger("""
SELECT model, score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, precision, recall, f1
FROM curve""", extra=FEATURES_SQL + ",\n" + SCORED_SQL))
def q_pr_curve(spark, sf_dir):
    return M.pr_curve(_scored(spark, sf_dir)).select("model", "score", "tp", "fp", "precision",
                                                     "recall", "f1")


@register("eval_metrics", with_ledger("""
SELECT b.model, b.precision, b.recall,
  CASE WHEN b.tp > 0 THEN CAST(2.0 AS DOUBLE) * b.tp / (CAST(2.0 AS DOUBLE) * b.tp + b.fp + (b.P - b.tp))
       ELSE 0.0 END AS f1,
  ROUND(a.ap, 10) AS auprc, u.u2 / (CAST(2.0 AS DOUBLE) * u.P * u.N) AS roc_auc,
  b.score AS best_threshold, CAST(b.N - b.fp AS BIGINT) AS tn, CAST(b.fp AS BIGINT) AS fp,
  CAST(b.P - b.tp AS BIGINT) AS fn, CAST(b.tp AS BIGINT) AS tp
FROM (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY f1 DESC, score) AS r
                     FROM curve) WHERE r = 1) b
JOIN (SELECT model, SUM(CASE WHEN P > 0 THEN CAST(pos AS DOUBLE) / P * precision END) AS ap
      FROM curve GROUP BY model) a USING (model)
JOIN (SELECT model, SUM(pos * (2 * below + neg)) AS u2, SUM(pos) AS P, SUM(neg) AS N FROM (
        SELECT *, SUM(neg) OVER (PARTITION BY model ORDER BY score ROWS UNBOUNDED PRECEDING) - neg AS below
        FROM per) GROUP BY model) u USING (model)""", extra=FEATURES_SQL + ",\n" + SCORED_SQL))
def q_eval_metrics(spark, sf_dir):
    m = M.metrics(_scored(spark, sf_dir))
    return m.withColumn("auprc", F.round("auprc", 10))


@register("confusion_matrix", with_ledger("""
SELECT s.model,
  CAST(COUNT(*) FILTER (WHERE label <> 1 AND score < t) AS BIGINT) AS tn,
  CAST(COUNT(*) FILTER (WHERE label <> 1 AND score >= t) AS BIGINT) AS fp,
  CAST(COUNT(*) FILTER (WHERE label = 1 AND score < t) AS BIGINT) AS fn,
  CAST(COUNT(*) FILTER (WHERE label = 1 AND score >= t) AS BIGINT) AS tp
FROM scored s JOIN (SELECT model, score AS t FROM (SELECT *, ROW_NUMBER() OVER (
    PARTITION BY model ORDER BY f1 DESC, score) AS r FROM curve) WHERE r = 1) b USING (model)
GROUP BY s.model""", extra=FEATURES_SQL + ",\n" + SCORED_SQL))
def q_confusion(spark, sf_dir):
    sc = written(_scored(spark, sf_dir))         # read for the thresholds and for the counts
    return M.confusion(sc, M.metrics(sc))
