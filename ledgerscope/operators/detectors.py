"""Rule detectors E1-E6 and the velocity check E8.

Every detector maps a ledger to findings (``FINDING_SCHEMA``) for all accounts in one
Spark job.  Ordering "by step" means ``(step, row_id)``.  Money sums are exact
decimals reported as double.  No detector collects a group or enumerates all pairs of
a group:

* rapid_drain: forward minimum of balance-after from windows over (sender, step) and
  over per-step aggregates; where zero or negative amounts let a sum fail, a search for undominated
  (running sum, balance) points over a tree of positions; then one bounded band check per sender.
* round_trip: equi-join on the reversed pair, an 11-step time bucket and a log-scale amount
  bucket, so a hot pair only compares rows of similar time and amount.
* fan_out / fan_in: distinct counterparty counts of every window from +1/-1 range deltas
  and a running sum over per-(account, step) aggregates (no per-window expansion).
* dormant_activation: ``rank() <= 3`` by step (Spark computes a per-task top-3 before the
  shuffle), row ids only where a step's rows share the third place, against an exact median passed as a scalar subquery.
* balance_inconsistency: one global aggregate.
* high_velocity: per-(account, step) counts, then a range window over steps.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.functions.core import exact_median, global_running_sum, money, written
from ledgerscope.operators.findings import dyadic_nodes
from ledgerscope.operators.ledger_ops import participations
from ledgerscope.operators.leg_counts import counter
from ledgerscope.schemas import FINDING_COLUMNS, FINDING_SCHEMA
from ledgerscope.session import checkpoint_dir, ship_package

# Confidence of each rule (fixed values).
CONFIDENCE = {
    "rapid_drain": 0.90,
    "round_trip": 0.85,
    "fan_out": 0.75,
    "fan_in": 0.70,
    "dormant_activation": 0.80,
    "balance_inconsistency": 1.0,
}


def empty_findings(spark) -> DataFrame:
    return spark.createDataFrame([], FINDING_SCHEMA)


def _finding(pattern: str, account, step_start, step_end, amount, confidence: float, description):
    return [
        F.lit(pattern).alias("pattern"),
        account.cast("string").alias("account_id"),
        step_start.cast("long").alias("step_start"),
        step_end.cast("long").alias("step_end"),
        amount.cast("double").alias("amount"),
        F.lit(float(confidence)).alias("confidence"),
        description.alias("description"),
    ]


def _needs(ledger: DataFrame, *cols: str) -> bool:
    return all(c in ledger.columns for c in cols)


def _empty(ledger: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    out = empty_findings(ledger.sparkSession)
    for c in reversed(by):
        dtype = ledger.schema[c].dataType if c in ledger.columns else "string"
        out = out.select(F.lit(None).cast(dtype).alias(c), *out.columns)
    return out


def _known(*cols: str) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in cols])


def _stretches(reach: int, wide: int = 16) -> tuple[Column, Column]:
    """(stretches, core) of a row: time is cut into stretches (``_stretch_width``).  A row is listed
    in the stretch of its step (its core) and, near the start of it, in the one before: so a stretch has
    all rows up to ``reach`` steps after any of its core steps, and (account, stretch) can be worked on alone."""
    width = _stretch_width(reach, wide)
    core = F.floor(F.col("step") / width)
    return F.sequence(F.floor((F.col("step") - reach) / width), core), core


def _stretch_width(reach: int, wide: int = 16) -> int:
    return wide * (reach + 1)


#: Most bits of the hashes that ``_in_places`` sends to every task: a bitmap of at most 2^28 bits, 32 MB.
_HASH_BITS = 28


def _in_places(rows: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` occur in ``places`` (and, by hash collisions, a few others), without a shuffle of
    the rows: the hashes of the places are a bitmap, blocks of 64 words of 64 bits, which reaches the rows as a scalar
    subquery."""
    spark = rows.sparkSession
    checkpoint_dir(spark)
    places = places.select(F.xxhash64(*keys).alias("_h")).checkpoint()
    bits = max(12, min(_HASH_BITS, (16 * places.count()).bit_length()))
    h, low = F.col("_h").bitwiseAND(F.lit((1 << bits) - 1)), F.lit(63).cast("long")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(low).cast("int"))
    words = places.select(F.shiftright(h, 6).alias("_w"), one.alias("_b")).unionByName(
        spark.range(1 << (bits - 6)).select(F.col("id").alias("_w"), F.lit(0).cast("long").alias("_b")))

    def gathered(df: DataFrame, keys: list[Column], at: str, value: str, out: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(at, value))).getField(value).alias(out))

    blocks = gathered(words.groupBy("_w").agg(F.bit_or("_b").alias("_b")), [F.shiftright("_w", 6).alias("_block")], "_w", "_b", "_bits")
    bitmap = gathered(blocks, [], "_block", "_bits", "_blocks").checkpoint().scalar()
    h = F.xxhash64(*keys).bitwiseAND(F.lit((1 << bits) - 1))
    word = F.get(F.get(bitmap, F.shiftright(h, 12).cast("int")), F.shiftright(h, 6).bitwiseAND(low).cast("int"))
    return rows.where(F.bit_get(word, h.bitwiseAND(low).cast("int")) == 1)


# --------------------------------------------------------------------------- E1
def drain_candidates(ledger: DataFrame, remain: float = 0.1) -> DataFrame:
    """D-4: per sender max balance-before, min balance-after, max amount; senders that
    can possibly drain (a strict superset of the firing ones)."""
    stats = ledger.groupBy("sender_id").agg(
        F.max("sender_balance_before").alias("max_before"),
        F.min("sender_balance_after").alias("min_after"), F.max("amount").alias("max_amount"))
    return stats.where((F.col("max_before") > 0)
                       & (F.col("min_after") < F.lit(remain) * F.col("max_before"))
                       & (F.col("max_amount") > 0))


def fan_candidates(ledger: DataFrame, role: str = "out", min_distinct: int = 5) -> DataFrame:
    """D-5: accounts with more than ``min_distinct`` distinct counterparties (exact)."""
    acct, cpty = ("sender_id", "receiver_id") if role == "out" else ("receiver_id", "sender_id")
    return (ledger.select(F.col(acct).alias("account_id"), F.col(cpty).alias("cpty"))
            .where(F.col("account_id").isNotNull() & F.col("cpty").isNotNull()).distinct()
            .groupBy("account_id").agg(F.count(F.lit(1)).alias("n_counterparties"))
            .where(F.col("n_counterparties") > min_distinct))


#: Rows of a node of the search tree of ``_dominated_starts`` per node below it, in bits.
_FAN_BITS = 4


def _staircase(points: Column) -> Column:
    """Of (s, a) points, those that no other dominates (greater or equal s, less or equal a), by s
    descending: a point is only needed if its a is below all a of greater s."""
    by_s = F.array_sort(points, lambda x, y: F.when(x["s"] > y["s"], -1).when(x["s"] < y["s"], 1)
                        .when(x["a"] < y["a"], -1).when(x["a"] > y["a"], 1).otherwise(0))
    empty = F.filter(by_s, lambda x: F.lit(False))
    return F.aggregate(by_s, empty, lambda kept, x: F.when(
        (F.size(kept) == 0) | (F.element_at(kept, -1)["a"] > x["a"]), F.concat(kept, F.array(x))).otherwise(kept))


def _cover(lo: Column, hi: Column, height: int) -> Column:
    """Nodes (level, node) of the search tree that make up the positions [lo, hi]."""
    def some(level: int, first: Column, end: Column) -> Column:
        nodes = F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(nodes, lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))

    out, fan = [], _FAN_BITS
    for level in range(height + 1):
        left = -F.shiftright(-lo, fan * level)                          # first whole node
        end = F.shiftright(hi + 1, fan * level)
        up, down = -F.shiftright(-left, fan), F.shiftright(end, fan)      # whole nodes of the next level
        split = (up < down) & F.lit(level < height)
        out += [some(level, left, F.when(split, F.shiftleft(up, fan)).otherwise(end)),
                some(level, F.when(split, F.shiftleft(down, fan)).otherwise(end), end)]
    return F.concat(*out)


def _dominated_starts(seq: DataFrame, asked: DataFrame, k: list[str]) -> DataFrame:
    """(k, step, row_id) of the asked rows i that have a row j in their band with
    sum(amount[i..j]) > 0 and after_j < y_i.

    ``seq`` (k, lo, s, a): position, running sum and balance-after of the rows; ``asked`` (k, step, row_id, lo, hi, x,
    y): band [lo, hi] and running sum x before the row.  j must have s_j > x and a small balance: a
    search for a point above and below given values among the positions of the band.  A tree over the
    positions (16 nodes to a node) holds the staircase of undominated (s, a) points of each
    node; a band is made up of a logarithmic number of nodes, and each is one lookup.  No row
    is compared with all rows of its band.
    """
    longest = asked.agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0]
    height = max(0, (int(longest).bit_length() - 1) // _FAN_BITS)
    level = seq.where(F.col("a").isNotNull()).select(
        *k, F.lit(0).alias("level"), F.col("lo").alias("node"), F.array(F.struct("s", "a")).alias("front"))
    level = written(level)
    tree = level
    for h in range(1, height + 1):
        level = (level.groupBy(*k, F.shiftright("node", _FAN_BITS).alias("node"))
                 .agg(_staircase(F.flatten(F.collect_list("front"))).alias("front"))
                 .select(*k, F.lit(h).alias("level"), "node", "front"))
        level = written(level)
        tree = tree.unionByName(level)
    lookups = asked.select(*k, "step", "row_id", "x", "y", F.explode(_cover(F.col("lo"), F.col("hi"), height)).alias("_n")).select(
        *k, "step", "row_id", "x", "y", "_n.level", "_n.node")
    hit = lookups.join(tree, [*k, "level", "node"]).where(
        F.exists("front", lambda f: (f["s"] > F.col("x")) & (f["a"] < F.col("y"))))
    return hit.select(*k, "step", "row_id").distinct()


def _level(x: Column) -> Column:
    """A small number that never falls as x grows (6 % to a level), so that a < y is only possible where
    ``_level(a) <= _level(y)``."""
    return (F.when(F.isnan(x), 32001).when(x <= 0, -32001)
            .otherwise(F.greatest(F.lit(-32000), F.least(F.lit(32000), F.floor(F.ln(x) * 16)))).cast("short"))


def _drain_rows(listed: DataFrame, core: Column, k: list[str], remain: float) -> tuple[DataFrame, bool]:
    """The rows of the (sender, stretch) that may have the sender's first firing pair (and some others), and whether
    sums can fall there.  One balance-after must be small beside one balance-before; and where every amount is
    positive and a core row drains by itself, later stretches are not needed.  One shuffle of short (sender, stretch)
    extremes decides, and the whole rows of other stretches are not shuffled at all."""
    checkpoint_dir(listed.sparkSession)
    y = F.lit(remain) * F.col("b")
    alone = (core == F.col("stretch")) & (F.col("b") > 0) & (F.col("a") < y)
    able = listed.groupBy(*k, "stretch").agg(
        F.max(F.when(F.col("b") > 0, _level(y))).alias("y"), F.min(_level(F.col("a"))).alias("a"),
        F.bool_or(F.coalesce(alone, F.lit(False))).alias("alone"),
        F.bool_and(F.coalesce(money("amount") > 0, F.lit(False))).alias("paid"),
        F.bool_or(F.coalesce(F.col("amount") <= 0, F.lit(True))).alias("signed")).where("a <= y").select(
        *k, "stretch", (F.col("alone") & F.col("paid")).alias("sure"), "signed").checkpoint()
    last = able.where("sure").groupBy(*k).agg(F.min("stretch").alias("last"))
    places = able.join(last, k, "left").where(F.col("last").isNull() | (F.col("stretch") <= F.col("last")))
    return (_in_places(listed, places.select(*k, "stretch"), [*k, "stretch"]),
            not able.where("signed").isEmpty())


def rapid_drain(ledger: DataFrame, max_gap: int = 5, remain: float = 0.1,
                confidence: float = CONFIDENCE["rapid_drain"], by: tuple[str, ...] = ()
                ) -> DataFrame:
    """First pair (i, j), i <= j in sender order, step_j - step_i <= max_gap, with
    before_i > 0, after_j < remain * before_i and sum(amount[i..j]) > 0; at most one
    finding per sender (amount = that sum).  ``by`` (e.g. ``("case_id",)``) analyses
    many ledgers at once: every key below is prefixed with it.

    The rows that matter are shuffled once, by (sender, stretch of time); all windows below work inside these.
    """
    need = ("sender_id", "step", "row_id", "amount", "sender_balance_before", "sender_balance_after")
    if not _needs(ledger, *need, *by):
        return _empty(ledger, by)
    k = [*by, "sender_id"]
    g = [*k, "stretch"]
    rows = ledger.where(_known(*k, "step")).select(
        *k, "step", "row_id", "amount",
        F.col("sender_balance_before").alias("b"), F.col("sender_balance_after").alias("a"))
    listed, core = _stretches(max_gap, 8)
    # Without an amount <= 0 every sum that begins with the start is > 0.
    r, signed = _drain_rows(rows.select("*", F.explode(listed).alias("stretch")), core, k, remain)
    r = r.repartition(*g)

    # Forward minimum of balance-after over j in [i, last row with step <= step_i + gap]: rows of the same
    # step at or after i (a suffix minimum, written as a growing frame over descending row_id),
    # and all rows of the next `gap` steps (a frame that is the same for all rows of a step).
    in_order = Window.partitionBy(*g).orderBy("step", "row_id")
    by_step = Window.partitionBy(*g).orderBy("step")
    same_step = Window.partitionBy(*g, "step").orderBy(F.col("row_id").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    later = by_step.rangeBetween(1, max_gap)
    zero = F.lit(0).cast("decimal(38,6)")
    if signed:
        r = r.withColumn("m", F.coalesce(money("amount"), zero)).withColumns({
            "s": F.sum("m").over(in_order.rowsBetween(Window.unboundedPreceding, 0)),
            "lo": F.row_number().over(in_order) - 1}).withColumn("same_max_s", F.max("s").over(same_step))
    fwd = r.withColumn("same_min_a", F.min("a").over(same_step)).withColumns({
        "later_min_a": F.min("a").over(later),
        "least": F.coalesce(F.min("amount").over(by_step.rangeBetween(0, max_gap)), F.lit(0.0))})
    # Necessary condition for row i to start a firing pair.
    necessary = (core == F.col("stretch")) & (F.col("b") > 0) & (
        F.least("same_min_a", "later_min_a") < F.lit(remain) * F.col("b"))
    # With no negative amount in the band and amount_i > 0 every later sum is > 0,
    # so the necessary condition is exact ("sure" rows).
    sure = F.coalesce(necessary & (F.col("amount") > 0) & (F.col("least") >= 0), F.lit(False))
    pos = F.struct("step", "row_id")
    is_start = F.col("sure")
    fwd = fwd.withColumn("sure", sure)
    if signed:
        # Of the rows before the first sure one, those where the sum test can fail but holds for some j.
        fwd = fwd.withColumns({
            "hi": F.count(F.lit(1)).over(by_step.rangeBetween(Window.unboundedPreceding, max_gap)) - 1,
            "max_s": F.greatest("same_max_s", F.max("s").over(later))})
        x = F.col("s") - F.col("m")
        asked = (fwd.withColumn("fs", F.min(F.when(F.col("sure"), pos)).over(Window.partitionBy(*g)))
                 .where(necessary & ~F.col("sure") & (F.col("max_s") > x) & (F.col("fs").isNull() | (pos < F.col("fs")))))
        asked = written(asked.select(*g, "step", "row_id", "lo", "hi", x.alias("x"), (F.lit(remain) * F.col("b")).alias("y")))
        if not asked.isEmpty():
            ours = fwd.join(asked.select(*g).distinct(), g, "left_semi").select(*g, "lo", "s", "a")
            found = _dominated_starts(ours, asked, g).groupBy(*g).agg(F.min(pos).alias("es"))
            fwd = fwd.join(found, g, "left")
            is_start = is_start | F.coalesce(pos == F.col("es"), F.lit(False))

    # Band check: the first start of each (sender, stretch) meets the rows of its step .. step + gap.
    first_start = F.min(F.when(is_start, F.struct("step", "row_id", (-F.col("b")).alias("nb")))).over(Window.partitionBy(*g))
    i_pos = F.struct("i.step", "i.row_id")
    band = (fwd.withColumn("i", first_start).select(*g, "step", "row_id", "a", "i", F.coalesce(money("amount"), zero).alias("m"))
            .where((F.col("step") <= F.col("i.step") + max_gap) & (pos >= i_pos)))
    run = in_order.rowsBetween(Window.unboundedPreceding, 0)
    band = band.withColumns({"starts": F.count_if(pos == i_pos).over(run), "sum": F.sum("m").over(run)})
    # rows that share the start's (step, row_id) are starts of their own: each adds the rows up to j once, and
    # the least sum > 0 on the way counts (``v``: how often j itself is in it)
    m, starts = F.col("m"), F.col("starts")
    earlier = (F.col("sum") - m) * starts
    v = (F.when(starts == 1, 1).when(m < 0, F.least(starts, F.ceil(earlier / -m) - 1))
         .when(m > 0, F.greatest(F.lit(1), F.floor(-earlier / m) + 1)).otherwise(1)).cast("long")
    band = band.withColumn("v", v).withColumn("s", (earlier + m * F.col("v")).cast("decimal(38,6)"))
    fired = band.where((F.col("a") < F.lit(remain) * -F.col("i.nb")) & (F.col("s") > 0) & F.col("v").between(1, starts))
    first = (fired.groupBy(*g).agg(F.min(F.struct(F.col("i.step").alias("i_step"), "step", "row_id", "s")).alias("f"))
             .groupBy(*k).agg(F.min(F.struct("stretch", "f.i_step", "f.step", "f.s")).alias("f")))
    return first.select(*by, *_finding("rapid_drain", F.col("sender_id"), F.col("f.i_step"),
                                       F.col("f.step"), F.col("f.s"), confidence,
                                       F.lit("Rapid drain detected")))


# --------------------------------------------------------------------------- E2
#: A set of keys up to this size is sent to every task (8 bytes or a few short columns each).
_FEW = 1 << 20


def _both_ways(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, Column, str] | None:
    """Join arguments that keep the rows whose ``keys`` occur in both directions (and, by hash collisions, a few
    others): only a short hash of every row is shuffled.  None if these are too many to send around."""
    short = F.xxhash64(*keys).bitwiseAND(F.lit((1 << 44) - 1))
    way = F.when(F.col("p") == F.col("q"), 3).when(F.col("up"), 1).otherwise(2)
    checkpoint_dir(rows.sparkSession)
    met = (rows.select(short.alias("_h"), way.alias("_w")).groupBy("_h").agg(F.bit_or("_w").alias("_w"))
           .where("_w = 3").select("_h").checkpoint())
    return (F.broadcast(met), short == F.col("_h"), "left_semi") if met.count() <= _FEW else None


def round_trip(ledger: DataFrame, max_gap: int = 10, tolerance: float = 0.05,
               confidence: float = CONFIDENCE["round_trip"], by: tuple[str, ...] = ()
               ) -> DataFrame:
    """Every row pair A->B then B->A with 0 <= step2 - step1 <= max_gap, amount1 > 0 and
    |a1 - a2| / a1 <= tolerance; one finding per pair (account A, amount a1).
    """
    if not _needs(ledger, "sender_id", "receiver_id", "step", "amount", *by):
        return _empty(ledger, by)
    # Every row is listed once for each place where it can be leg 1: (unordered pair, stretch of time,
    # amount bucket), one of which is its own.  Rows meet only there, and only where both directions occur:
    # where that is rare, rows without the other direction are not shuffled at all.
    amount = F.col("amount")
    listed, core = _stretches(max_gap, 8)
    rows = ledger.where(_known(*by, "sender_id", "receiver_id", "step", "amount")).select(
        *by, F.least("sender_id", "receiver_id").alias("p"), F.greatest("sender_id", "receiver_id").alias("q"),
        (F.col("sender_id") <= F.col("receiver_id")).alias("up"), "step", "amount", F.explode(listed).alias("stretch"))
    keys = [*by, "p", "q", "stretch"]
    own, met = F.lit(True), None
    if 0 < tolerance < 0.5:
        # Amount buckets on a log scale: a matching amount2 lies in
        # [amount1 * (1 - tol), amount1 * (1 + tol)], so leg 1 is listed under every bucket
        # that range can reach (a 1e-9 margin in log space covers rounding; buckets are eight
        # tolerances wide, so that is at most two) and leg 2 under its own.  A hot pair then
        # compares only rows of similar amount; the exact test below still decides.
        w = 8 * math.log1p(tolerance)
        lo = F.floor((F.ln(amount * (1 - tolerance)) - 1e-9) / w)
        hi = F.floor((F.ln(amount * (1 + tolerance)) + 1e-9) / w)
        # amount2 <= 0 can never be within tol < 1 of a positive amount1
        rows = rows.where(amount > 0)
        met = _both_ways(rows, keys)
        keys.append("abucket")
        own = F.floor(F.ln(amount) / w) == F.col("abucket")
    rows = rows.join(*met) if met else rows
    if "abucket" in keys:
        rows = rows.withColumn("abucket", F.explode(F.sequence(lo, hi)))
    place = Window.partitionBy(*keys)
    rows = rows.repartition(*keys).withColumns({"any_up": F.bool_or("up").over(place), "all_up": F.bool_and("up").over(place)}).where(
        (F.col("any_up") & ~F.col("all_up")) | (F.col("p") == F.col("q")))
    leg1 = rows.where((amount > 0) & (core == F.col("stretch"))).select(
        *keys, "up", F.col("step").alias("step1"), F.col("amount").alias("amount1"))
    leg2 = rows.where(own).select(*keys, F.col("up").alias("up2"), F.col("step").alias("step2"), F.col("amount").alias("amount2"))
    pairs = leg1.join(leg2, keys).where(
        ((F.col("up") != F.col("up2")) | (F.col("p") == F.col("q")))
        & (F.col("step2") >= F.col("step1")) & (F.col("step2") - F.col("step1") <= max_gap)
        & (F.try_divide(F.abs(F.col("amount1") - F.col("amount2")), F.col("amount1"))
           <= F.lit(tolerance))).withColumns({
        "a": F.when(F.col("up"), F.col("p")).otherwise(F.col("q")), "b": F.when(F.col("up"), F.col("q")).otherwise(F.col("p"))})
    return pairs.select(*by, *_finding(
        "round_trip", F.col("a"), F.col("step1"), F.col("step2"), F.col("amount1"), confidence,
        F.concat(F.lit("Round trip: "), F.col("a"), F.lit(" -> "), F.col("b"), F.lit(" -> "),
                 F.col("a"))))


def _tolerated(m: Column, side: int, tolerance: float) -> Column:
    """The least (side -1) or greatest (side 1) double c with |m - c| / m <= tolerance in floating
    point: the doubles around m * (1 +- tolerance) are tried (steps of at most half a unit in the last place)."""
    c0 = m * (1 + side * tolerance)
    tried = F.transform(F.sequence(F.lit(-20), F.lit(20)), lambda i: c0 + i * (m * 5e-17))
    ok = F.filter(tried, lambda c: F.abs(m - c) / m <= F.lit(tolerance))
    return F.array_max(ok) if side > 0 else F.array_min(ok)


def round_trip_counts(ledger: DataFrame, max_gap: int = 10, tolerance: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """E2 without its pairs: per first leg with a match, ``row_id``, ``account_id``, ``counterparty``, ``step``,
    ``amount``, ``n_matches`` (second legs that ``round_trip`` would pair with it) and a representative:
    ``match_amount``, ``match_step`` of the match of greatest amount (of these, the earliest).

    Rows are listed and shuffled once under (unordered pair, stretch of time), as in ``round_trip``, without their row_id
    where they are second legs only; places with one direction only are dropped before.  A place is counted in a task by
    order statistics (``leg_counts``), n log n for a pair that trades back and forth all day.  Places of more than
    ``_HELD_ROWS`` rows are counted in range partitions instead (``_counts_in_order``), so no task holds them.
    """
    if not 0 <= tolerance < 1:
        raise ValueError("tolerance lies in [0, 1)")
    spark = ledger.sparkSession
    checkpoint_dir(spark)
    ship_package(spark)
    both = ledger.where(F.col("sender_id").isNotNull() & F.col("receiver_id").isNotNull())
    amount = F.col("amount").cast("double")
    listed, core = _stretches(max_gap, 8)
    keys = [*by, "p", "q", "stretch"]
    rows = both.where((amount > 0) & F.col("step").isNotNull()).select(
        *by, F.least("sender_id", "receiver_id").alias("p"), F.greatest("sender_id", "receiver_id").alias("q"),
        (F.col("sender_id") <= F.col("receiver_id")).alias("up"), "step", amount.alias("m"), "row_id",
        F.explode(listed).alias("stretch")).withColumn("own", core == F.col("stretch")).withColumn(
        "row_id", F.when(F.col("own"), F.col("row_id")))
    short = F.xxhash64(*keys).bitwiseAND(F.lit((1 << 44) - 1))
    way = F.when(F.col("p") == F.col("q"), 3).when(F.col("up"), 1).otherwise(2)
    met = (rows.select(short.alias("_h"), way.alias("_w")).groupBy("_h").agg(F.bit_or("_w").alias("_w"), F.count(F.lit(1)).alias("_n"))
           .where("_w = 3").select("_h", "_n").checkpoint())
    if met.count() <= _FEW:
        rows = rows.join(F.broadcast(met), short == F.col("_h"), "left_semi")
    held = met.where(F.col("_n") > _HELD_ROWS).select("_h")
    large = None
    if not held.isEmpty():
        large = _counts_in_order(rows.join(F.broadcast(held), short == F.col("_h"), "left_semi"), [*by, "stretch"], max_gap, tolerance)
        rows = rows.join(F.broadcast(held), short == F.col("_h"), "left_anti")
    names = [*by, "row_id", "account_id", "counterparty", "step", "amount", "n_matches", "match_amount", "match_step"]
    kinds = [*[ledger.schema[c].dataType for c in [*by, "row_id", "sender_id", "sender_id", "step"]],
             T.DoubleType(), T.LongType(), T.DoubleType(), T.LongType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    out = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        counter(keys, list(by), max_gap, _stretch_width(max_gap, 8), tolerance, names), schema)
    return out if large is None else out.unionByName(large.select(*names))


#: Rows of a (pair, stretch of time) that a task may hold in numpy.
_HELD_ROWS = 1_000_000


def _counts_in_order(rows: DataFrame, by: list[str], max_gap: int, tolerance: float) -> DataFrame:
    """``round_trip_counts`` of rows (by, p, q, up, step, m, row_id, own), of which the ``own`` are first legs.

    Range counting over time x amount: a leg's steps [step, step + max_gap] are a few dyadic nodes,
    and per pair and node the second legs are counted by amount.  All nodes of all pairs are one
    order, (pair, node, amount), whose running count is taken over range partitions; a leg's
    matches in a node are the difference of the counts at its two bounds.  No task or window holds a pair.
    """
    sender, receiver = F.when(F.col("up"), F.col("p")).otherwise(F.col("q")), F.when(F.col("up"), F.col("q")).otherwise(F.col("p"))
    first = rows.where("own").select(*by, sender.alias("a"), receiver.alias("b"), "step", "row_id", "m")
    asked = first.select("*", F.explode(dyadic_nodes(F.col("step").cast("long"), F.col("step").cast("long") + max_gap)).alias("_n"))
    bounds = F.explode(F.array(
        F.struct(_tolerated(F.col("m"), -1, tolerance).alias("value"), F.lit(0).alias("kind")),
        F.struct(_tolerated(F.col("m"), 1, tolerance).alias("value"), F.lit(2).alias("kind"))))
    asked = asked.select(*by, "a", "b", F.col("_n.level").alias("level"), F.col("_n.node").alias("node"),
                         bounds.alias("_v"), F.struct("step", "row_id", "m").alias("leg"))
    levels = range((max_gap + 1).bit_length())
    second = rows.select(
        *by, receiver.alias("a"), sender.alias("b"), F.col("step").cast("long").alias("step"), "m",
        F.explode(F.array(*[F.lit(k) for k in levels])).alias("level"))
    key = [*by, "a", "b", "level", "node"]
    second = second.select(
        *by, "a", "b", "level", F.call_function("shiftright", F.col("step"), F.col("level")).alias("node"),
        F.struct(F.col("m").alias("value"), F.lit(1).alias("kind")).alias("_v"),
        F.lit(None).cast(asked.schema["leg"].dataType).alias("leg"), F.col("step").alias("of"), F.lit(1).cast("long").alias("c"))
    events = second.unionByName(asked.withColumn("of", F.lit(None).cast("long")).withColumn("c", F.lit(0).cast("long")))
    # of equal amounts, the earliest step comes last
    order = F.struct(*key, F.col("_v.value"), F.col("_v.kind"), (-F.col("of")).alias("late"))
    ranked = global_running_sum(events.withColumn("_k", order), "_k", ["c"])
    ends = ranked.where(F.col("leg").isNotNull())
    kind = F.col("_v.kind")
    counts = ends.groupBy(*key, "leg").agg(F.sum(F.when(kind == 2, F.col("cum_c")).otherwise(-F.col("cum_c"))).alias("n"),
                                           F.max(F.when(kind == 2, F.col("cum_c"))).alias("rank"),
                                           (F.count(F.lit(1)) / 2).alias("copies")).where("n > 0")
    last = ranked.where(F.col("leg").isNull()).select(F.col("cum_c").alias("rank"), F.struct(
        F.col("_v.value").alias("amount"), (-F.col("of")).alias("late")).alias("match"))
    found = counts.join(last, "rank").groupBy(*by, "a", "b", "leg").agg(
        F.sum("n").alias("n"), F.max("match").alias("match"), F.max("copies").alias("copies"))
    # rows without an own row_id are counted together
    return found.select(*by, F.col("leg.row_id").alias("row_id"), F.col("a").alias("account_id"), F.col("b").alias("counterparty"),
                        F.col("leg.step").alias("step"), F.col("leg.m").alias("amount"),
                        F.floor(F.col("n") / F.col("copies")).alias("n_matches"), F.col("match.amount").alias("match_amount"),
                        (-F.col("match.late")).alias("match_step"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")
                        ).drop("_copy")


# ---------------------------------------------------------------------- E3 / E4
def _fan_rows(rows: DataFrame, k: list[str], span: int, min_distinct: int) -> DataFrame:
    """The rows that the first window of an account may need (and some others): time is cut into cells as long
    as a window, so a window lies in two neighbours.  With more than ``min_distinct`` counterparties one of them
    has at least half as many rows; and where a cell alone has enough counterparties (as many distinct hash
    values), the account's first window starts there at the latest.  One shuffle of (account, cell) counts
    decides, and the whole rows of other cells are not shuffled at all."""
    if span < 0 or min_distinct < 1:
        return rows
    rows = rows.withColumn("_cell", F.floor(F.col("step") / (span + 1)))
    checkpoint_dir(rows.sparkSession)
    met = F.when(F.col("cpty").isNotNull(), F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("cpty"), F.lit(64)).cast("int")))
    dense = rows.groupBy(*k, "_cell").agg(F.count("cpty").alias("c"), F.bit_or(met).alias("met")).where(
        F.col("c") * 2 > min_distinct).select(*k, "_cell", (F.bit_count("met") > min_distinct).alias("sure")).checkpoint()
    last = dense.where("sure").groupBy(*k).agg((F.min("_cell") + 1).alias("last"))
    near = F.explode(F.array(F.col("_cell") - 1, F.col("_cell"), F.col("_cell") + 1))
    places = dense.join(last, k, "left").select(*k, "last", near.alias("_cell")).where(
        F.col("last").isNull() | (F.col("_cell") <= F.col("last"))).select(*k, "_cell")
    return _in_places(rows, places, [*k, "_cell"]).drop("_cell")


def fan(ledger: DataFrame, role: str = "out", span: int = 10, min_distinct: int = 5,
        confidence: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """E3 (role='out') / E4 (role='in'): the first start step s of the account's rows whose
    window [s, s + span] holds more than ``min_distinct`` distinct counterparties;
    step_end = last step in the window, amount = window total; one finding per account.
    """
    if role == "out":
        acct, cpty, pattern, noun, verb = "sender_id", "receiver_id", "fan_out", "receivers", "to"
    elif role == "in":
        acct, cpty, pattern, noun, verb = "receiver_id", "sender_id", "fan_in", "senders", "from"
    else:
        raise ValueError("role must be 'out' or 'in'")
    if confidence is None:
        confidence = CONFIDENCE[pattern]
    if not _needs(ledger, acct, cpty, "step", "amount", *by):
        return _empty(ledger, by)
    k = [*by, "acct"]
    g = [*k, "stretch"]
    listed, _ = _stretches(span)
    rows = ledger.where(_known(*by, acct, "step")).select(
        *by, F.col(acct).alias("acct"), F.col(cpty).alias("cpty"), "step", "amount")
    rows = _fan_rows(rows, k, span, min_distinct)
    base = (rows.select("*", F.explode(listed).alias("stretch"))
            .repartition(*g))        # once; all below works inside (account, stretch of time)
    cells = base.groupBy(*g, "cpty", "step").agg(F.sum(money("amount")).alias("m")).withColumn(
        "prev", F.lag("step").over(Window.partitionBy(*g, "cpty").orderBy("step")))
    # Distinct counterparties of the window starting at s, for every s at once: an
    # occurrence of c at step t (previous occurrence p) is the first one inside the window
    # exactly for s in [max(t - span, p + 1), t].  Those +1 ranges become +1/-1 deltas,
    # and the count at s is their running sum over the account's steps (``ends``: the -1 after s).
    first_in = F.greatest(F.col("step") - span, F.coalesce(F.col("prev") + 1, F.col("step") - span))
    none, one = F.lit(None).cast("decimal(38,6)"), F.when(F.col("cpty").isNotNull(), 1).otherwise(0)
    at = (cells.select(*g, F.explode(F.array(
        F.struct(first_in.alias("s"), one.alias("d"), F.lit(0).alias("ends"), F.lit(False).alias("is_start"), none.alias("m")),
        F.struct(F.col("step").alias("s"), F.lit(0).alias("d"), one.alias("ends"), F.lit(True).alias("is_start"),
                 F.col("m").cast("decimal(38,6)").alias("m"))
    )).alias("x")).select(*g, "x.*").groupBy(*g, "s").agg(
        F.sum("d").alias("d"), F.sum("ends").alias("ends"), F.bool_or("is_start").alias("is_start"), F.sum("m").alias("m")))
    steps = Window.partitionBy(*g).orderBy("s")
    window = steps.rangeBetween(0, span)
    so_far = steps.rowsBetween(Window.unboundedPreceding, 0)
    counts = at.withColumns({
        "n": F.sum("d").over(so_far) - F.sum("ends").over(so_far) + F.col("ends"),
        "step_end": F.max(F.when(F.col("is_start"), F.col("s"))).over(window), "amount": F.sum("m").over(window)})
    in_core = F.floor(F.col("s") / _stretch_width(span)) == F.col("stretch")
    window = (counts.where(F.col("is_start") & (F.col("n") > min_distinct) & in_core).groupBy(*k)
              .agg(F.min(F.struct(F.col("s").alias("start"), "n", "step_end", "amount")).alias("f")).select(*k, "f.*"))
    return window.select(*by, *_finding(
        pattern, F.col("acct"), F.col("start"), F.col("step_end"), F.col("amount"), confidence,
        F.format_string(f"Fan {role} {verb} %d {noun}", F.col("n"))))


def fan_out(ledger: DataFrame, span: int = 10, min_distinct: int = 5,
            confidence: float = CONFIDENCE["fan_out"], by: tuple[str, ...] = ()) -> DataFrame:
    return fan(ledger, "out", span, min_distinct, confidence, by)


def fan_in(ledger: DataFrame, span: int = 10, min_distinct: int = 5,
           confidence: float = CONFIDENCE["fan_in"], by: tuple[str, ...] = ()) -> DataFrame:
    return fan(ledger, "in", span, min_distinct, confidence, by)


# --------------------------------------------------------------------------- E5
def amount_median(ledger: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """D-6: exact median of all amounts (column ``median``; one row per ``by`` group)."""
    return exact_median(ledger, "amount", by=by)


def dormant_activation(ledger: DataFrame, max_prior: int = 3, median_factor: float = 2.0,
                       confidence: float = CONFIDENCE["dormant_activation"],
                       by: tuple[str, ...] = ()) -> DataFrame:
    """E5: the sender had fewer than ``max_prior`` earlier participations (either role; rows
    by step, sender before receiver) and amount > median_factor * median(all amounts)."""
    if not _needs(ledger, "sender_id", "receiver_id", "amount", "step", "row_id", *by):
        return _empty(ledger, by)
    k = [*by, "account_id"]
    parts = participations(ledger, extra=list(by))
    med = amount_median(ledger, by)
    amount = F.col("amount")
    sent = F.col("slot") == 0
    if by:
        # one median per ledger: a table with one row per group
        def large(rows: DataFrame, value: Column) -> DataFrame:
            return rows.join(med, list(by)).where(value > F.lit(float(median_factor)) * F.col("median"))

        sent_large = sent
    else:
        threshold = F.lit(float(median_factor)) * med.scalar()

        def large(rows: DataFrame, value: Column) -> DataFrame:
            return rows.where(value > threshold)

        sent_large = sent & (amount > threshold)
    # The rank by step alone needs no row_id, and a filter on it lets Spark keep a per-task top-k before the
    # shuffle.  It decides all rows but those of a step that has the k-th and the next participation.
    ranked = parts.select(*k, "step", F.when(sent_large, amount).alias("x")).withColumn(
        "rn", F.rank().over(Window.partitionBy(*k).orderBy("step"))).where(F.col("rn") <= max_prior)
    ranked = ranked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*k, "step")))
    checkpoint_dir(ledger.sparkSession)
    early = large(ranked.where(F.col("x").isNotNull()), F.col("x")).select(*k, "step", "x", "rn", "n").checkpoint()
    last = F.col("rn") + F.col("n") - 1
    hits = early.where(last <= max_prior).select(*k, "step", F.col("x").alias("amount"))
    tied = early.where(last > max_prior).select(*[F.col(c).alias(f"_{c}") for c in (*k, "step")], "rn").distinct()
    n_tied = tied.count()
    if n_tied:
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*k, "step")])
        cell = parts.join(F.broadcast(tied) if n_tied <= _FEW else tied, same).select(*k, "step", "row_id", "slot", "amount", "rn")
        place = F.row_number().over(Window.partitionBy(*k, "step").orderBy("row_id", "slot")) + F.col("rn") - 1
        cell = cell.withColumn("place", place).where(sent & (F.col("place") <= max_prior))
        hits = hits.unionByName(large(cell, amount).select(*k, "step", "amount"))
    return hits.select(*by, *_finding("dormant_activation", F.col("account_id"), F.col("step"),
                                      F.col("step"), F.col("amount"), confidence,
                                      F.lit("Dormant account activation")))


# --------------------------------------------------------------------------- E6
def balance_inconsistency(ledger: DataFrame, tolerance: float = 0.01,
                          confidence: float = CONFIDENCE["balance_inconsistency"],
                          by: tuple[str, ...] = ()) -> DataFrame:
    """One dataset-level finding (account DATASET) per ledger when any sender side fails
    |before - after - amount| <= tolerance; nothing when all rows reconcile.
    """
    if not _needs(ledger, "sender_balance_before", "sender_balance_after", "amount", "step", *by):
        return _empty(ledger, by)
    bad = F.abs(F.col("sender_balance_before") - F.col("sender_balance_after")
                - F.col("amount")) > tolerance
    agg = ledger.groupBy(*by).agg(
        F.count_if(bad).alias("n_bad"), F.count(F.lit(1)).alias("n"),
        F.min(F.when(bad, F.col("step"))).alias("s0"), F.max(F.when(bad, F.col("step"))).alias("s1"),
        F.sum(F.when(bad, money("amount"))).alias("amt"),
    ).where(F.col("n_bad") > 0)
    desc = F.format_string(
        "%d of %d transactions (%.1f%%) fail balance reconciliation - "
        "evidence-level data integrity flag",
        F.col("n_bad"), F.col("n"), F.col("n_bad") * 100.0 / F.col("n"))
    return agg.select(*by, *_finding("balance_inconsistency", F.lit("DATASET"), F.col("s0"),
                                     F.col("s1"), F.col("amt"), confidence, desc))


# --------------------------------------------------------------------------- E8
def high_velocity(ledger: DataFrame, window: int = 10, threshold: int = 8,
                  by: tuple[str, ...] = ()) -> DataFrame:
    """Accounts (either role) with more than ``threshold`` participations inside some
    span of ``window`` consecutive steps (step_r - step_l < window).  Column ``account_id``.
    """
    p = participations(ledger, extra=list(by))
    per_step = p.groupBy(*by, "account_id", "step").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by, "account_id").orderBy("step").rangeBetween(-(window - 1), 0)
    return (per_step.withColumn("in_window", F.sum("c").over(w))
            .where(F.col("in_window") > threshold).select(*by, "account_id").distinct())


DETECTORS = {
    "rapid_drain": rapid_drain,
    "round_trip": round_trip,
    "fan_out": fan_out,
    "fan_in": fan_in,
    "dormant_activation": dormant_activation,
    "balance_inconsistency": balance_inconsistency,
}

__all__ = ["drain_candidates", "fan_candidates", "rapid_drain", "round_trip", "fan", "fan_out", "fan_in", "dormant_activation",
           "balance_inconsistency", "high_velocity", "amount_median", "empty_findings",
           "DETECTORS", "CONFIDENCE", "FINDING_COLUMNS"]
