"""Policy what-if and the fraud playbook.

What-if evaluates a scenario table of any size in one pass over the invoices:
invoices become cells between the scenarios' limits, and scenarios ask for sums
over the cells that occur.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhawk.functions.columns import blank_text, is_high, is_risky, money
from tallyhawk.operators.ordinal import with_ordinal
from tallyhawk.session import materialize

# fixed values
DEFAULT_VENDOR_AGE = 9999
NEW_VENDOR_DAYS = 30
NEAR_LIMIT_LOW = 95000
APPROVAL_LIMIT = 100000
WATCHLIST_N = 5

RECOMMENDATIONS = [
    # (rank, count column, title, priority, impact, reason template, action)
    (1, "above_threshold_count", "Strengthen dual approval for high-value invoices", "HIGH", "HIGH",
     "%d invoices are at or above ₹100000 and should use stricter approval routing.",
     "Set mandatory dual approval above ₹100000 and require approver escalation for unusual vendors."),
    (2, "new_vendor_count", "Apply enhanced review to new vendors", "HIGH", "HIGH",
     "%d invoices are linked to vendors aged 30 days or less.",
     "Block or review invoices from new vendors until onboarding, GST, and bank verification are confirmed."),
    (3, "bank_change_count", "Enforce dual verification for bank changes", "HIGH", "HIGH",
     "%d invoices involve bank change signals, which are sensitive fraud indicators.",
     "Require maker-checker validation and out-of-band confirmation for all vendor bank account changes."),
    (4, "no_po_count", "Tighten no-PO invoice controls", "MEDIUM", "HIGH",
     "%d invoices appear to have missing PO information.",
     "Require exception approval and reason code for no-PO invoices, especially above policy threshold."),
    (5, "near_threshold_count", "Review split-value invoices near approval limit", "MEDIUM", "MEDIUM",
     "%d invoices are close to the ₹100000 approval boundary.",
     "Create an alert for invoices between ₹95000 and ₹99999 to detect possible approval circumvention."),
    (6, "risky_invoices", "Create daily risky invoice review queue", "MEDIUM", "MEDIUM",
     "%d invoices are currently rated HIGH or MEDIUM risk.",
     "Route risky invoices into a daily AP control queue with owner, aging, and disposition tracking."),
]
QUICK_WINS = [
    "Enable dual approval for invoices above ₹100000.",
    "Apply 30-day hold/review for new vendors.",
    "Require dual verification for vendor bank changes.",
    "Alert on invoices just below approval thresholds.",
    "Track top risky vendors weekly.",
]
EXEC_TEMPLATE = ("The current invoice population contains %d risky invoices with total risky "
                 "exposure of ₹%s. Priority controls should focus on high-value approvals, "
                 "new-vendor review, bank-change verification, and targeted monitoring of risky vendors.")


def _vendor_age(df: DataFrame) -> F.Column:
    if "VendorAgeDays" in df.columns:
        return F.coalesce(F.col("VendorAgeDays").cast("double"), F.lit(float(DEFAULT_VENDOR_AGE)))
    return F.lit(float(DEFAULT_VENDOR_AGE))


def _po_missing(df: DataFrame) -> F.Column:
    return blank_text("PONumber") if "PONumber" in df.columns else F.lit(True)


def _amount(df: DataFrame) -> F.Column:
    return F.coalesce(F.col("Amount"), F.lit(0.0))


def _dsum(cond) -> F.Column:
    return F.coalesce(F.sum(F.when(cond, money("Amount"))), F.lit(0))


#: Distinct limits up to which they are written into the plan (eight bytes each); more are merged with the rows by sorting.
PLAN_LIMITS = 20_000


def _limits(values: DataFrame) -> DataFrame:
    """(v, place): distinct limits with their 1-based position, a written table."""
    placed = with_ordinal(values.distinct(), ["v"], "o")
    return materialize(placed.select("v", (F.col("o") + 1).cast("int").alias("place")), "policy-limits")


def _binned(rows: DataFrame, limits: DataFrame, count: int, name: str, out: str, plan_limits: int) -> DataFrame:
    """``rows`` with ``out``, the number of limits at or below the column ``name`` (NaN lies above all)."""
    if not count:
        return rows.withColumn(out, F.lit(0))
    if count <= plan_limits:
        splits = [-float("inf"), *sorted(r["v"] for r in limits.collect()), float("inf")]
        put = Bucketizer(splits=splits, inputCol=name, outputCol="_bin", handleInvalid="keep").transform(rows)
        return put.withColumn(out, F.least(F.col("_bin").cast("int"), F.lit(count))).drop("_bin")
    # limits and rows in one order, limits first among equals: a row's bin is the last limit before it
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != name]
    both = rows.withColumn("_place", F.lit(None).cast("int")).unionByName(
        limits.select(F.col("v").alias(name), F.col("place").alias("_place"), *blank))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(name), F.col("_place").asc_nulls_last()]
    ranged = materialize(both.repartitionByRange(parts, name).withColumn("_part", F.spark_partition_id()), "policy-ranges")
    here = F.last("_place", ignorenulls=True).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)     # one row per range
    carried = ranged.groupBy("_part").agg(F.max("_place").alias("_top")).select("_part", F.max("_top").over(earlier).alias("_carried"))
    return (ranged.withColumn("_here", here).where("_place is null").join(F.broadcast(carried), "_part")
            .withColumn(out, F.coalesce("_here", "_carried", F.lit(0))).drop("_place", "_part", "_here", "_carried"))


def _dominance(cells: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """For each (ab, yb) of ``asked``: sums over the cells at or above both, of all (n, r, m) and of those without PO.

    Amount bins from the top down form a binary tree. A cell counts for the nodes above it, a question for the
    at most log2(bins) nodes that make up the bins it reaches; inside a node, cells and questions are merged by age. Cells that
    do not occur and nodes that nobody asks for have no rows."""
    levels = max(1, (top + 1).bit_length())
    nodes = (f"filter(transform(sequence(0, {levels}), k -> if((shiftright(at, k) & 1) = {{bit}}, "
             "struct(k AS k, shiftright(at, k) - {bit} AS node), null)), x -> x is not null)")
    sums = {f"{kind}{c}": F.sum(F.when(F.lit(kind == "a") | F.col("nopo"), F.col(c))) for kind in "ao" for c in "nrm"}
    zero = {c: F.lit(0) for c in sums}
    questions = materialize(asked.select("ab", "yb").distinct().withColumn("at", F.lit(top + 1) - F.col("ab"))
                            .select("ab", "yb", F.explode(F.expr(nodes.format(bit=1))).alias("x")).select("ab", "yb", "x.k", "x.node"), "policy-questions")
    inside = (cells.withColumn("at", F.lit(top) - F.col("ab")).select("*", F.explode(F.expr(nodes.format(bit=0))).alias("x"))
              .select("x.k", "x.node", "yb", "nopo", "n", "r", "m"))
    inside = (inside.join(questions.select("k", "node").distinct(), ["k", "node"], "left_semi")
              .groupBy("k", "node", "yb").agg(*[v.alias(c) for c, v in sums.items()]))
    both = inside.withColumn("ab", F.lit(None).cast("int")).unionByName(
        questions.withColumns({c: v.cast(inside.schema[c].dataType) for c, v in zero.items()}))
    older = Window.partitionBy("k", "node").orderBy(F.col("yb").desc(), F.col("ab").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    running = both.select("ab", "yb", *[F.coalesce(F.sum(c).over(older), F.lit(0)).alias(c) for c in sums]).where("ab is not null")
    return running.groupBy("ab", "yb").agg(*[F.sum(c).alias(c) for c in sums])


def what_if(scored: DataFrame, scenarios: DataFrame, plan_limits: int = PLAN_LIMITS) -> DataFrame:
    """G1 + G2 for a table of scenarios (scenario_id, min_amount_dual_approval,
    block_new_vendor_days, block_no_po_min_amount); 0 or null switches a rule off.

    All rules are limits, so each invoice is binned once by the distinct limits
    and invoices are aggregated to cells (amount bin, age bin, no PO). Every scenario asks for at
    most eight sums over the cells at or above an amount and at or below an age
    and combines them by inclusion and exclusion. No invoice meets a scenario, and the work
    grows with cells and limits times the logarithm of the limits. ``plan_limits`` only
    chooses how rows are binned; results are the same at any value."""
    sc = scenarios.select(
        F.col("scenario_id").cast("string").alias("scenario_id"),
        F.coalesce(F.col("min_amount_dual_approval").cast("double"), F.lit(0.0)).alias("a"),
        F.coalesce(F.col("block_new_vendor_days").cast("double"), F.lit(0.0)).alias("d"),
        F.coalesce(F.col("block_no_po_min_amount").cast("double"), F.lit(0.0)).alias("p"))
    amounts = _limits(sc.select(F.explode(F.array("a", "p")).alias("v")).where("v > 0"))
    youths = _limits(sc.where("d > 0").select((-F.col("d")).alias("v")))
    n_amounts, n_youths = amounts.count(), youths.count()
    base = scored.select(_amount(scored).alias("amount"), (-_vendor_age(scored)).alias("youth"),
                         _po_missing(scored).alias("nopo"), is_risky().alias("risky"),
                         money(_amount(scored)).alias("money"))
    # bin k of an amount: at or above the first k limits; likewise for minus the age
    base = _binned(base, amounts, n_amounts, "amount", "ab", plan_limits)
    base = _binned(base, youths, n_youths, "youth", "yb", plan_limits)
    cells = base.groupBy("ab", "yb", "nopo").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("risky"), 1)).alias("r"),
        F.coalesce(F.sum(F.when(F.col("risky"), F.col("money"))), F.lit(0)).alias("m"))
    cells = materialize(cells, "policy-cells")

    at = lambda limits, key, place: limits.select(F.col("v").alias(key), F.col("place").alias(place))
    placed = (sc.join(at(amounts, "a", "ai"), "a", "left").join(at(amounts, "p", "pi"), "p", "left")
              .join(at(youths, "nd", "di"), F.col("nd") == -F.col("d"), "left")
              .select("scenario_id", F.monotonically_increasing_id().alias("sk"),
                      *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ai", "pi", "di")]))
    placed = materialize(placed, "policy-scenarios")
    on = {"dual": F.col("ai") > 0, "newv": F.col("di") > 0, "nopo": F.col("pi") > 0}
    top = F.greatest("ai", "pi")
    # rule sets → (amount bin, age bin, no PO only) of the invoices that meet all rules of the set
    sets = [("all", F.lit(True), F.lit(0), F.lit(0), False, 0),
            ("dual", on["dual"], F.col("ai"), F.lit(0), False, 1), ("newv", on["newv"], F.lit(0), F.col("di"), False, 1),
            ("nopo", on["nopo"], F.col("pi"), F.lit(0), True, 1),
            ("dual_newv", on["dual"] & on["newv"], F.col("ai"), F.col("di"), False, -1),
            ("dual_nopo", on["dual"] & on["nopo"], top, F.lit(0), True, -1),
            ("newv_nopo", on["newv"] & on["nopo"], F.col("pi"), F.col("di"), True, -1),
            ("every", on["dual"] & on["newv"] & on["nopo"], top, F.col("di"), True, 1)]
    asked = placed.select("sk", F.explode(F.filter(F.array(*[
        F.when(cond, F.struct(F.lit(name).alias("rules"), ab.cast("int").alias("ab"), yb.cast("int").alias("yb"),
                              F.lit(nopo).alias("nopo"), F.lit(sign).alias("sign")))
        for name, cond, ab, yb, nopo, sign in sets]), lambda s: s.isNotNull())).alias("s")).select("sk", "s.*")
    asked = materialize(asked, "policy-asked")
    met = asked.join(_dominance(cells, asked, n_amounts), ["ab", "yb"]).select(
        "sk", "rules", "sign", *[F.when(F.col("nopo"), F.col(f"o{c}")).otherwise(F.col(f"a{c}")).alias(c) for c in "nrm"])
    of = lambda name, c: F.coalesce(F.sum(F.when(F.col("rules") == name, F.col(c))), F.lit(0))
    signed = lambda c: F.coalesce(F.sum(F.col(c) * F.col("sign")), F.lit(0))
    agg = met.groupBy("sk").agg(
        of("all", "r").alias("base_risky_invoices"), of("all", "m").alias("base_amt"),
        signed("r").cast("long").alias("blocked_risky_invoices"), signed("m").alias("blk_amt"),
        of("dual", "n").alias("dual_approval_hits"), of("newv", "n").alias("new_vendor_hits"),
        of("nopo", "n").alias("no_po_hits"), signed("n").cast("long").alias("total_policy_hits"))
    return placed.select("scenario_id", "sk").join(agg, "sk").select(
        "scenario_id", "base_risky_invoices", F.col("base_amt").cast("double").alias("base_risky_amount"),
        "blocked_risky_invoices", F.col("blk_amt").cast("double").alias("blocked_risk_amount"),
        (F.col("base_risky_invoices") - F.col("blocked_risky_invoices")).alias("new_risky_invoices"),
        (F.col("base_amt") - F.col("blk_amt")).cast("double").alias("new_risk_amount"),
        "dual_approval_hits", "new_vendor_hits", "no_po_hits", "total_policy_hits",
        F.when(F.col("base_risky_invoices") > 0,
               F.col("blocked_risky_invoices").cast("double") / F.col("base_risky_invoices") * F.lit(100.0)
               ).otherwise(F.lit(0.0)).alias("blocked_percentage"))


def scenario_grid(spark, amounts, days, no_po_amounts) -> DataFrame:
    """Cartesian grid of policy parameters as a scenario table."""
    rows = [(f"s{i:05d}", float(a), int(d), float(p))
            for i, (a, d, p) in enumerate((a, d, p) for a in amounts for d in days for p in no_po_amounts)]
    return spark.createDataFrame(rows, "scenario_id string, min_amount_dual_approval double, "
                                       "block_new_vendor_days int, block_no_po_min_amount double")


def playbook_counts(scored: DataFrame) -> DataFrame:
    """G3 plus the at/above-limit count used by G4 (one global aggregate)."""
    amt = _amount(scored)
    bank = (F.upper(F.col("BankChangeFlag").cast("string")) == "Y") if "BankChangeFlag" in scored.columns \
        else F.lit(False)
    return scored.agg(
        F.count(F.when(is_risky(), 1)).alias("risky_invoices"),
        F.count(F.when(is_high(), 1)).alias("high_risk_invoices"),
        _dsum(is_risky()).cast("double").alias("risky_amount"),
        _dsum(is_high()).cast("double").alias("high_risk_amount"),
        F.count(F.when(bank, 1)).alias("bank_change_count"),
        F.count(F.when(_vendor_age(scored) <= NEW_VENDOR_DAYS, 1)).alias("new_vendor_count"),
        F.count(F.when(_po_missing(scored), 1)).alias("no_po_count"),
        F.count(F.when((amt >= NEAR_LIMIT_LOW) & (amt < APPROVAL_LIMIT), 1)).alias("near_threshold_count"),
        F.count(F.when(amt >= APPROVAL_LIMIT, 1)).alias("above_threshold_count"))


def playbook_headline(scored: DataFrame) -> DataFrame:
    return playbook_counts(scored).drop("above_threshold_count")


def playbook_recommendations(scored: DataFrame) -> DataFrame:
    """The fixed rule table against the one-row headline, kept when count > 0."""
    rules = F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(title).alias("title"), F.lit(prio).alias("priority"),
                               F.lit(impact).alias("impact"), F.format_string(reason, F.col(cnt)).alias("reason"),
                               F.lit(action).alias("action"), F.col(cnt).alias("n"))
                      for rank, cnt, title, prio, impact, reason, action in RECOMMENDATIONS])
    return (playbook_counts(scored).select(F.explode(rules).alias("r")).where("r.n > 0")
            .select("r.rank", "r.title", "r.priority", "r.impact", "r.reason", "r.action").orderBy("rank"))


def watchlist_vendors(scored: DataFrame, n: int = WATCHLIST_N) -> DataFrame:
    """G5."""
    return (scored.where(is_risky()).groupBy("Vendor").agg(
                F.count("InvoiceID").alias("risky_invoices"),
                F.coalesce(F.sum(money("Amount")).cast("double"), F.lit(0.0)).alias("risky_amount"),
                F.max(F.coalesce(F.col("RiskScore"), F.lit(0.0))).alias("max_score"))
            .select(F.coalesce(F.col("Vendor"), F.lit("(Unknown)")).alias("vendor"),
                    "risky_invoices", "risky_amount", "max_score")
            .orderBy(F.col("risky_amount").desc(), F.col("risky_invoices").desc(), "vendor")
            .limit(n))


def playbook_summary(scored: DataFrame) -> DataFrame:
    """Executive text and the five quick wins as rows (kind, position, text)."""
    text = F.format_string(EXEC_TEMPLATE, F.col("risky_invoices"), F.format_number(F.col("risky_amount"), 2))
    rows = F.array(F.struct(F.lit("executive_summary").alias("kind"), F.lit(0).alias("position"), text.alias("text")),
                   *[F.struct(F.lit("quick_win").alias("kind"), F.lit(i).alias("position"), F.lit(win).alias("text"))
                     for i, win in enumerate(QUICK_WINS, 1)])
    return playbook_counts(scored).select(F.explode(rows).alias("r")).select("r.kind", "r.position", "r.text")
