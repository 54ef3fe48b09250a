"""Analytics over stored findings (B7, B8, B12, C6, C11, D-8, D-9, D-10, S1, S2).

Stored findings carry ``case_id, finding_type, severity, description, account_ids,
step_start, step_end, confidence, amount``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.core import severity_rank
from ledgerscope.session import checkpoint_dir

DATASET = "DATASET"


def parse_account_ids(findings: DataFrame, col: str = "account_ids") -> DataFrame:
    """findings imported with ``account_ids`` as JSON text become ``array<string>``."""
    return findings.withColumn(col, F.from_json(F.col(col), "array<string>"))


def case_findings(findings: DataFrame, case_id: str) -> DataFrame:
    """One case's findings (partition-pruned when the store is partitioned by case)."""
    return findings.where(F.col("case_id") == case_id)


def findings_for_account(findings: DataFrame, account_id: str) -> DataFrame:
    """Findings naming an account."""
    return findings.where(F.array_contains("account_ids", account_id))


def finding_accounts(findings: DataFrame) -> DataFrame:
    """B8 for all accounts at once: one row per (finding, named account), with ``pos``."""
    return findings.select("*", F.posexplode("account_ids").alias("pos", "account_id"))


def first_account_of_pattern(findings: DataFrame, finding_type: str) -> DataFrame:
    """First account of the first finding of a type (order: step_start, account)."""
    return (findings.where(F.col("finding_type") == finding_type)
            .select(F.element_at("account_ids", 1).alias("account_id"), "step_start")
            .orderBy("step_start", "account_id").limit(1).select("account_id"))


def pattern_counts(findings: DataFrame) -> DataFrame:
    """D-9: findings per (case, type)."""
    return findings.groupBy("case_id", "finding_type").agg(F.count(F.lit(1)).alias("count"))


def findings_breakdown(findings: DataFrame) -> DataFrame:
    """D-10: per type count and ROUND(AVG(confidence), 2), plus a TOTAL line per case.

    ``ord`` numbers the lines: types by count desc (then name), TOTAL last.
    """
    g = findings.rollup("case_id", "finding_type").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("confidence"), 2).alias("avg_confidence"),
        F.grouping("finding_type").alias("is_total"), F.grouping("case_id").alias("_all"))
    g = g.where(F.col("_all") == 0)
    w = Window.partitionBy("case_id").orderBy(F.col("is_total"), F.col("count").desc(),
                                              F.col("finding_type"))
    return g.select(
        "case_id",
        F.when(F.col("is_total") == 1, F.lit("TOTAL")).otherwise(F.col("finding_type"))
        .alias("finding_type"),
        "count",
        F.when(F.col("is_total") == 1, F.lit(None).cast("double")).otherwise(F.col("avg_confidence"))
        .alias("avg_confidence"),
        F.row_number().over(w).cast("long").alias("ord"))


def _sort_key(findings: DataFrame) -> DataFrame:
    return findings.withColumn("sev_rank", severity_rank("severity")).withColumn(
        "first_account", F.element_at("account_ids", 1))


def _top_order():
    return [F.col("sev_rank").desc(), F.col("confidence").desc(), F.col("amount").desc_nulls_last(),
            F.col("first_account"), F.col("step_start"), F.col("step_end"),
            F.col("finding_type"), F.col("description")]


def top_findings(findings: DataFrame, n: int = 100) -> DataFrame:
    """The n most severe findings (severity, confidence, amount desc; then account, steps).

    ``rank`` is the 1-based position; ``total`` the number of findings in the case.
    """
    k = _sort_key(findings)
    total = findings.groupBy("case_id").agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("case_id").orderBy(*_top_order())
    # a filter on the rank itself becomes a per-task top-n before the shuffle
    top = (k.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
           .withColumn("rank", F.col("rank").cast("long")))
    return top.join(total, "case_id").drop("sev_rank")


def top_accounts(findings: DataFrame, n: int = 5) -> DataFrame:
    """The first n distinct accounts in S1 order, DATASET excluded."""
    ex = finding_accounts(findings).where(F.col("account_id") != DATASET).withColumn(
        "sev_rank", severity_rank("severity"))
    best = ex.groupBy("case_id", "account_id").agg(F.max(F.struct(
        "sev_rank", "confidence", F.coalesce("amount", F.lit(float("-inf"))).alias("amount"),
        (-F.col("step_start")).alias("neg_start"))).alias("k"))
    order = [F.col("k.sev_rank").desc(), F.col("k.confidence").desc(), F.col("k.amount").desc(),
             F.col("account_id"), F.col("k.neg_start").desc()]
    w = Window.partitionBy("case_id").orderBy(*order)
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("case_id", "account_id", F.col("rank").cast("long").alias("rank")))


_OPEN_END = 9223372036854775807


def merge_intervals(intervals: DataFrame, keys: list[str], start: str = "step_start",
                    end: str = "step_end") -> DataFrame:
    """Disjoint pieces covering the union of closed integer step intervals per key.

    Each interval adds +1 at its start and -1 after its end; the deltas are summed per
    (key, step) first (partial aggregation: a hot key collapses to its distinct steps),
    and a running sum over those steps marks covered pieces [s, next_s - 1].  An end of
    2^63 - 1 means open-ended.
    """
    iv = intervals.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    deltas = iv.select(*keys, F.explode(F.array(
        F.struct(F.col("_s").alias("at"), F.lit(1).alias("d")),
        F.when(F.col("_e") < _OPEN_END, F.struct((F.col("_e") + 1).alias("at"),
                                                 F.lit(-1).alias("d"))))).alias("x"))
    at = (deltas.where(F.col("x").isNotNull()).select(*keys, "x.at", "x.d")
          .groupBy(*keys, "at").agg(F.sum("d").alias("d")))
    w = Window.partitionBy(*keys).orderBy("at")
    cov = (at.withColumn("cover", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("next_at", F.lead("at").over(w)))
    return cov.where(F.col("cover") > 0).select(
        *keys, F.col("at").alias(start),
        F.coalesce(F.col("next_at") - 1, F.lit(_OPEN_END)).alias(end))


def dyadic_nodes(lo: Column, hi: Column) -> Column:
    """The closed interval of integers [lo, hi] as an array of (level, node): node n of level k is
    [n * 2^k, (n + 1) * 2^k - 1].  At most two nodes of each level up to the interval's length, which
    are disjoint and cover it exactly."""
    levels = F.length(F.bin(hi - lo + 1)) - 1

    def at(k: Column) -> Column:
        left = -F.call_function("shiftright", -lo, k)              # ceil(lo / 2^k)
        right = F.call_function("shiftright", hi + 1, k)           # end, exclusive
        odd = [F.when((left < right) & (x.bitwiseAND(F.lit(1).cast("long")) == 1),
                      F.struct(k.cast("int").alias("level"), n.alias("node")))
               for x, n in ((left, left), (right, right - 1))]
        return F.array(*odd)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), levels), at)), lambda x: x.isNotNull())


#: Longer pieces are cut to the points' range before they are decomposed.
_LONG = 1 << 24


def step_hits(points: DataFrame, pieces: DataFrame, keys: list[str], step: str = "step",
              start: str = "step_start", end: str = "step_end") -> DataFrame:
    """``keys``, ``step``, ``start``, ``end`` and the other columns of ``pieces``: each distinct (keys, step)
    of the points with the pieces that hold it.

    Each piece is listed under its dyadic nodes (``dyadic_nodes``; at most two per level, so
    logarithmic in its length), and each distinct (keys, step) looks up its node of every level that
    occurs (at most 63).  A step lies in one node of a piece, so a lookup finds a piece once, and a
    hot key compares nothing with all of its pieces.  The pieces are written once to the shared
    checkpoint folder.
    """
    checkpoint_dir(points.sparkSession)
    rest = [c for c in pieces.columns if c not in (*keys, start, end)]
    p = pieces.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *rest,
                      F.col(start).cast("long").alias("_ps"), F.col(end).cast("long").alias("_pe")).checkpoint()
    lo, hi = F.col("_ps"), F.col("_pe")
    if not p.where((hi < lo) | (hi - lo >= _LONG) | (hi - lo < 0)).isEmpty():      # open ends
        rng = points.agg(F.struct(F.min(step).alias("lo"), F.max(step).alias("hi"))).scalar()
        lo, hi = F.greatest(lo, rng["lo"]), F.least(hi, rng["hi"])
    p = p.withColumns({"_lo": lo, "_hi": hi}).where(F.col("_lo") <= F.col("_hi"))
    nodes = p.select("*", F.explode(dyadic_nodes(F.col("_lo"), F.col("_hi"))).alias("_n"))
    levels = sorted(r[0] for r in nodes.select("_n.level").distinct().collect())
    steps = points.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)],
                          F.col(step).cast("long").alias("_step")).distinct()
    steps = steps.select("*", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")).alias("_level"))
    same = [F.col(f"_p{i}") == F.col(f"_k{i}") for i in range(len(keys))]
    hits = steps.join(nodes, [*same, F.col("_level") == F.col("_n.level"),
                              F.call_function("shiftright", F.col("_step"), F.col("_level")) == F.col("_n.node")])
    return hits.select(*[F.col(f"_p{i}").alias(k) for i, k in enumerate(keys)], F.col("_step").alias(step),
                       F.col("_ps").alias(start), F.col("_pe").alias(end), *rest)


#: Pieces of at most so many steps are listed step by step.
_SHORT = 64


def covered_steps(points: DataFrame, pieces: DataFrame, keys: list[str], step: str = "step",
                  start: str = "step_start", end: str = "step_end") -> DataFrame:
    """``step_hits`` that also may name steps without a point: short pieces are listed step by step, without
    a look at the points, and only longer ones are looked up for them."""
    checkpoint_dir(points.sparkSession)
    p = pieces.withColumns({start: F.col(start).cast("long"), end: F.col(end).cast("long")}).checkpoint()
    length = F.try_subtract(F.col(end), F.col(start))
    short = F.coalesce((F.col(start) <= F.col(end)) & (length < _SHORT), F.lit(False))
    listed = p.where(short).select(*keys, F.explode(F.sequence(F.col(start), F.col(end))).alias(step), start, end,
                                   *[c for c in p.columns if c not in (*keys, start, end)])
    longer = p.where(~short)
    return listed if longer.isEmpty() else listed.unionByName(step_hits(points, longer, keys, step, start, end))


def interval_join(points: DataFrame, pieces: DataFrame, keys: list[str], step: str = "step",
                  start: str = "step_start", end: str = "step_end", how: str = "inner") -> DataFrame:
    """Join each point to the disjoint piece (``merge_intervals``) of its key that holds
    its step (``covered_steps``): a point meets at most one piece, so the row count never grows."""
    hits = covered_steps(points, pieces, keys, step, start, end).select(
        *[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)], F.col(step).alias("_step"), start, end)
    on = [points[k] == hits[f"_p{i}"] for i, k in enumerate(keys)] + [points[step] == hits["_step"]]
    return points.join(hits, on, how).select(*[points[c] for c in points.columns], hits[start], hits[end])


def detection_rate(ledger: DataFrame, findings: DataFrame,
                   exclude: tuple[str, ...] = ("balance_inconsistency",)) -> DataFrame:
    """Share of fraud-labelled rows whose sender or receiver has a finding whose
    [step_start, step_end] contains the row's step.  Intervals become disjoint covered
    pieces per account first, so each (row, party) meets at most one piece.
    """
    iv = (finding_accounts(findings.where(~F.col("finding_type").isin(*exclude)))
          .select("account_id", "step_start", "step_end"))
    islands = merge_intervals(iv, ["account_id"])
    fraud = ledger.where(F.col("is_fraud")).select("row_id", "step", "sender_id", "receiver_id")
    parties = fraud.select("row_id", "step", F.explode(F.array_distinct(
        F.array("sender_id", "receiver_id"))).alias("account_id"))
    hit = interval_join(parties, islands, ["account_id"])
    hits = hit.select("row_id").distinct().agg(F.count(F.lit(1))).scalar()
    return fraud.agg(F.count(F.lit(1)).alias("fraud_rows")).select(
        "fraud_rows", hits.alias("hits"),
        F.try_divide(hits.cast("double"), F.col("fraud_rows")).alias("rate"))


def case_summary(cases: DataFrame, evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """D-8: per case evidence count, finding count, high/medium/low (always present) and
    the count of any other or missing severity."""
    ev = evidence.groupBy(F.col("case_id").alias("id")).agg(
        F.count(F.lit(1)).alias("evidence_count"))
    sev = F.lower("severity")
    fd = findings.groupBy(F.col("case_id").alias("id")).agg(
        F.count(F.lit(1)).alias("findings_count"),
        F.count_if(sev == "high").alias("high"), F.count_if(sev == "medium").alias("medium"),
        F.count_if(sev == "low").alias("low"),
        F.count_if(sev.isNull() | ~sev.isin("high", "medium", "low")).alias("other"))
    out = cases.select("id", "name", "investigator", "status").join(ev, "id", "left").join(
        fd, "id", "left")
    return out.fillna(0, ["evidence_count", "findings_count", "high", "medium", "low", "other"])


def case_list(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """C11: all cases with their finding counts, one aggregate pass."""
    fd = findings.groupBy(F.col("case_id").alias("id")).agg(
        F.count(F.lit(1)).alias("findings_count"))
    return cases.join(fd, "id", "left").fillna(0, ["findings_count"])
