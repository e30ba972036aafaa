"""Registered queries over the invoice fixture: rules, scores, reports, policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhawk.operators import policy, reports, rules
from tallyhawk.operators.risk import score_invoices
from tallyhawk.operators.rules import apply_rule_checks, vendor_medians
from tallyhawk.plans.oracle_sql import RISKY, lvl_rank, msum, msum_if, on_scored
from tallyhawk.plans.registry import register
from tallyhawk.sources.fixtures import invoice_view


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-only scored invoices (the forest is random; see SURVEY §5), saved once
    per session; reports read the saved table."""
    from tallyhawk.sources.fixtures import saved
    return saved(spark, f"scored:{sf_dir}", lambda: score_invoices(invoice_view(spark, sf_dir), ml=False))


def fresh_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring itself (rules + score) over the invoice table, not saved."""
    return score_invoices(invoice_view(spark, sf_dir), ml=False)


# ---- B: rules ---------------------------------------------------------------

@register("rule_exact_dup", on_scored(
    "SELECT InvoiceID, Rule_ExactDuplicate FROM scored"))
def q_rule_exact_dup(spark, sf):
    return rules.exact_duplicate(invoice_view(spark, sf)).select("InvoiceID", "Rule_ExactDuplicate")


@register("rule_soft_dup", on_scored(
    "SELECT InvoiceID, Rule_SoftDuplicate FROM scored"))
def q_rule_soft_dup(spark, sf):
    return rules.soft_duplicate(invoice_view(spark, sf)).select("InvoiceID", "Rule_SoftDuplicate")


@register("rule_missing_po", on_scored(
    "SELECT InvoiceID, PONumber, Rule_MissingPO FROM scored"))
def q_rule_missing_po(spark, sf):
    return rules.missing_po(invoice_view(spark, sf)).select("InvoiceID", "PONumber", "Rule_MissingPO")


@register("rule_non_positive", on_scored(
    "SELECT InvoiceID, Amount, Rule_NegativeOrZeroAmount FROM scored"))
def q_rule_non_positive(spark, sf):
    return rules.non_positive(invoice_view(spark, sf)).select("InvoiceID", "Amount", "Rule_NegativeOrZeroAmount")


@register("vendor_median", on_scored(
    "SELECT Vendor, median(Amount) AS VendorMedianAmount, count(*) AS invoices "
    "FROM inv GROUP BY Vendor"))
def q_vendor_median(spark, sf):
    inv = invoice_view(spark, sf)
    counts = inv.groupBy("Vendor").agg(F.count(F.lit(1)).alias("invoices"))
    return vendor_medians(inv).join(counts, "Vendor")


@register("rule_high_amount", on_scored(
    "SELECT InvoiceID, Amount, VendorMedianAmount, Rule_HighAmountForVendor FROM scored"))
def q_rule_high_amount(spark, sf):
    return rules.high_for_vendor(invoice_view(spark, sf)).select(
        "InvoiceID", "Amount", "VendorMedianAmount", "Rule_HighAmountForVendor")


@register("rule_flags", on_scored(
    "SELECT InvoiceID, array_to_string(Rule_Flags, '; ') AS flags, len(Rule_Flags) AS n_flags "
    "FROM scored"))
def q_rule_flags(spark, sf):
    return apply_rule_checks(invoice_view(spark, sf)).select(
        "InvoiceID", F.array_join("Rule_Flags", "; ").alias("flags"),
        F.size("Rule_Flags").alias("n_flags"))


# ---- E: risk ----------------------------------------------------------------

@register("risk_scores", on_scored(
    "SELECT InvoiceID, Vendor, Amount, RiskScore, RiskLevel, RiskReason FROM scored"))
def q_risk_scores(spark, sf):
    return fresh_scores(spark, sf).select("InvoiceID", "Vendor", "Amount", "RiskScore",
                                          "RiskLevel", "RiskReason")


@register("risk_levels", on_scored(
    "SELECT RiskLevel, RiskScore, count(*) AS invoices FROM scored GROUP BY RiskLevel, RiskScore"))
def q_risk_levels(spark, sf):
    return scored_table(spark, sf).groupBy("RiskLevel", "RiskScore").agg(
        F.count(F.lit(1)).alias("invoices"))


@register("risk_reasons", on_scored(
    "SELECT RiskReason, count(*) AS invoices FROM scored GROUP BY RiskReason"))
def q_risk_reasons(spark, sf):
    return scored_table(spark, sf).groupBy("RiskReason").agg(F.count(F.lit(1)).alias("invoices"))


# ---- F: reports ---------------------------------------------------------------

@register("run_summary", on_scored(f"""
SELECT count(*) AS total_invoices,
       count(*) FILTER (WHERE {RISKY}) AS risky_invoices,
       count(*) FILTER (WHERE RiskLevel = 'HIGH') AS high_risk_invoices,
       {msum_if(RISKY)} AS total_risk_amount,
       {msum_if("RiskLevel = 'HIGH'")} AS high_risk_amount
FROM scored"""))
def q_run_summary(spark, sf):
    return reports.run_summary(scored_table(spark, sf))


DISPLAY = "InvoiceID, Vendor, InvoiceNumber, InvoiceDate, Amount, Currency, PONumber, RiskLevel, RiskScore, RiskReason"

TOP20 = f"""SELECT {DISPLAY} FROM scored WHERE {RISKY}
ORDER BY {lvl_rank('RiskLevel')} DESC, RiskScore DESC, Amount DESC, CAST(InvoiceID AS BIGINT) LIMIT 20"""


@register("top_risky_invoices", on_scored(TOP20))
def q_top_risky_invoices(spark, sf):
    return reports.top_risky_invoices(scored_table(spark, sf))


#: Requests: the newest invoice number of every vendor, and one id that nobody has.
FOCUS = "SELECT CAST(max(CAST(InvoiceID AS BIGINT)) AS VARCHAR) AS InvoiceID FROM scored GROUP BY Vendor"


def focus_ids(scored):
    return scored.groupBy("Vendor").agg(F.max(F.col("InvoiceID").cast("long")).cast("string").alias("InvoiceID")) \
        .select("InvoiceID")


@register("invoice_lookup", on_scored(f"""
SELECT q.InvoiceID, s.{DISPLAY.split(', ', 1)[1].replace(', ', ', s.')}, s.InvoiceID IS NOT NULL AS found
FROM ({FOCUS} UNION ALL SELECT 'none') q LEFT JOIN scored s ON q.InvoiceID = s.InvoiceID"""))
def q_invoice_lookup(spark, sf):
    scored = scored_table(spark, sf)
    unknown = spark.createDataFrame([("none",)], "InvoiceID string")
    return reports.invoice_lookup(scored, focus_ids(scored).union(unknown))


@register("vendor_history", on_scored(f"""
SELECT q.InvoiceID AS focus_invoice_id, h.InvoiceID, h.InvoiceNumber, h.InvoiceDate, h.Amount,
       h.Currency, h.PONumber, h.RiskLevel, h.RiskScore
FROM (SELECT s.InvoiceID, s.Vendor FROM ({FOCUS}) f JOIN scored s USING (InvoiceID)) q
JOIN scored h ON h.Vendor = q.Vendor"""))
def q_vendor_history(spark, sf):
    scored = scored_table(spark, sf)
    return reports.vendor_history(scored, focus_ids(scored))


@register("vendor_risk_overview", on_scored(f"""
SELECT coalesce(Vendor, '(Unknown)') AS vendor, total_invoices, total_amount, risky_invoices,
       high_risk_invoices, risky_percentage, avg_score, max_score, last_invoice_date,
       CASE WHEN risky_percentage >= 40 OR max_score >= 0.9 THEN 'HIGH'
            WHEN risky_percentage >= 15 OR max_score >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier
FROM (
  SELECT Vendor, count(InvoiceID) AS total_invoices,
         coalesce({msum('Amount')}, 0.0) AS total_amount,
         count(*) FILTER (WHERE {RISKY}) AS risky_invoices,
         count(*) FILTER (WHERE RiskLevel = 'HIGH') AS high_risk_invoices,
         CASE WHEN count(InvoiceID) > 0 THEN
           CAST(count(*) FILTER (WHERE {RISKY}) AS DOUBLE) / count(InvoiceID) * 100.0::DOUBLE
           ELSE 0.0 END AS risky_percentage,
         {msum('coalesce(RiskScore, 0.0)')} / count(coalesce(RiskScore, 0.0)) AS avg_score,
         max(coalesce(RiskScore, 0.0)) AS max_score,
         coalesce(strftime(max(InvoiceDate), '%Y-%m-%d'), 'NaT') AS last_invoice_date
  FROM scored GROUP BY Vendor) g"""))
def q_vendor_risk_overview(spark, sf):
    return reports.vendor_risk_overview(scored_table(spark, sf))


@register("control_summary", on_scored(f"""
SELECT count(*) AS total_invoices,
       count(*) FILTER (WHERE {RISKY}) AS risky_invoices,
       count(*) FILTER (WHERE RiskLevel = 'HIGH') AS high_risk_invoices,
       coalesce({msum('Amount')}, 0.0) AS total_amount,
       {msum_if(RISKY)} AS total_risk_amount,
       {msum_if("RiskLevel = 'HIGH'")} AS high_risk_amount
FROM scored"""))
def q_control_summary(spark, sf):
    return reports.control_summary(scored_table(spark, sf))


@register("risk_distribution", on_scored("""
SELECT l.risk_level, coalesce(c.n, 0) AS count,
       CAST(coalesce(c.n, 0) AS DOUBLE) /
       CAST(CASE WHEN sum(coalesce(c.n, 0)) OVER () = 0 THEN 1
                 ELSE sum(coalesce(c.n, 0)) OVER () END AS DOUBLE) AS share
FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW'), ('UNKNOWN')) l(risk_level)
LEFT JOIN (SELECT RiskLevel, count(*) AS n FROM scored GROUP BY RiskLevel) c
  ON c.RiskLevel = l.risk_level"""))
def q_risk_distribution(spark, sf):
    return reports.risk_distribution(scored_table(spark, sf))


MONTH = "coalesce(strftime(InvoiceDate, '%Y-%m'), 'NaT')"


@register("monthly_trend", on_scored(f"""
SELECT {MONTH} AS month, count(InvoiceID) AS invoices,
       coalesce({msum('Amount')}, 0.0) AS total_amount,
       count(*) FILTER (WHERE {RISKY}) AS risky_invoices,
       count(*) FILTER (WHERE RiskLevel = 'HIGH') AS high_risk_invoices
FROM scored GROUP BY 1"""))
def q_monthly_trend(spark, sf):
    return reports.monthly_trend(scored_table(spark, sf))


TOP_VENDORS = f"""
SELECT coalesce(Vendor, '(Unknown)') AS vendor, coalesce({msum('Amount')}, 0.0) AS risky_amount,
       count(InvoiceID) AS risky_count, max(coalesce(RiskScore, 0.0)) AS max_score
FROM scored WHERE {RISKY} GROUP BY Vendor ORDER BY risky_amount DESC, vendor LIMIT 10"""


@register("top_risky_vendors", on_scored(TOP_VENDORS))
def q_top_risky_vendors(spark, sf):
    return reports.top_risky_vendors(scored_table(spark, sf))


@register("invoice_type_breakdown", on_scored(
    "SELECT InvoiceType, RiskLevel, count(*) AS count FROM scored GROUP BY ALL"))
def q_invoice_type_breakdown(spark, sf):
    return reports.invoice_type_breakdown(scored_table(spark, sf))


@register("cost_center_breakdown", on_scored(
    "SELECT CostCenter, RiskLevel, count(InvoiceID) AS count FROM scored GROUP BY ALL"))
def q_cost_center_breakdown(spark, sf):
    return reports.cost_center_breakdown(scored_table(spark, sf))


@register("score_histogram", on_scored("""
SELECT bin, CAST(bin AS DOUBLE) / 20.0::DOUBLE AS bin_start, count(*) AS count
FROM (SELECT CAST(least(19, floor(round(coalesce(RiskScore, 0.0), 3) * 20)) AS INT) AS bin FROM scored)
GROUP BY bin"""))
def q_score_histogram(spark, sf):
    return reports.score_histogram(scored_table(spark, sf))


@register("payment_status_breakdown", on_scored(f"""
SELECT PaymentStatus, RiskLevel, count(Amount) AS count, coalesce({msum('Amount')}, 0.0) AS total_amount
FROM scored GROUP BY ALL"""))
def q_payment_status_breakdown(spark, sf):
    return reports.payment_status_breakdown(scored_table(spark, sf))


VSB = f"""
SELECT VendorState, count(Amount) AS total,
       count(*) FILTER (WHERE {RISKY}) AS risky,
       count(*) FILTER (WHERE RiskLevel = 'HIGH') AS high_risk,
       coalesce({msum('Amount')}, 0.0) AS total_amount,
       {msum_if(RISKY)} AS risky_amount
FROM scored GROUP BY VendorState"""


@register("vendor_state_breakdown", on_scored(VSB))
def q_vendor_state_breakdown(spark, sf):
    return reports.vendor_state_breakdown(scored_table(spark, sf))


MAS = f"""
SELECT {MONTH} AS month,
       CAST(coalesce(sum(CAST(Amount AS DECIMAL(18,4))), 0) AS DOUBLE) AS total_amount,
       CAST(coalesce(sum(CASE WHEN {RISKY} THEN CAST(Amount AS DECIMAL(18,4)) END), 0) AS DOUBLE) AS risky_amount,
       CAST(coalesce(sum(CASE WHEN RiskLevel = 'HIGH' THEN CAST(Amount AS DECIMAL(18,4)) END), 0) AS DOUBLE) AS high_amount,
       CAST(coalesce(sum(CAST(Amount AS DECIMAL(18,4))), 0)
            - coalesce(sum(CASE WHEN {RISKY} THEN CAST(Amount AS DECIMAL(18,4)) END), 0) AS DOUBLE) AS safe_amount
FROM scored GROUP BY 1"""


@register("monthly_amount_split", on_scored(MAS))
def q_monthly_amount_split(spark, sf):
    return reports.monthly_amount_split(scored_table(spark, sf))


@register("chart_series", on_scored(f"""
SELECT 'month_medium' AS series, month AS label,
       greatest(0.0::DOUBLE, risky_amount - high_amount) AS value, CAST(NULL AS VARCHAR) AS band
FROM ({MAS}) m
UNION ALL
SELECT s.series, VendorState, s.value, NULL FROM (
  SELECT *, row_number() OVER (ORDER BY risky DESC, VendorState ASC NULLS FIRST) AS r FROM ({VSB}) v) v,
  LATERAL (VALUES ('state_low', CAST(greatest(0, total - risky) AS DOUBLE)),
                  ('state_medium', CAST(greatest(0, risky - high_risk) AS DOUBLE)),
                  ('state_high', CAST(high_risk AS DOUBLE))) s(series, value)
WHERE r <= 15
UNION ALL
SELECT 'vendor_band', vendor, risky_amount,
       CASE WHEN risky_amount > 500000 THEN 'high' WHEN risky_amount > 100000 THEN 'medium' ELSE 'low' END
FROM ({TOP_VENDORS}) t"""))
def q_chart_series(spark, sf):
    return reports.chart_series(scored_table(spark, sf))


@register("invoice_type_grid", on_scored("""
SELECT InvoiceType,
       count(*) FILTER (WHERE RiskLevel = 'HIGH') AS HIGH,
       count(*) FILTER (WHERE RiskLevel = 'MEDIUM') AS MEDIUM,
       count(*) FILTER (WHERE RiskLevel = 'LOW') AS LOW
FROM scored GROUP BY InvoiceType"""))
def q_invoice_type_grid(spark, sf):
    return reports.level_grid(scored_table(spark, sf), "InvoiceType")


# ---- G: policy ----------------------------------------------------------------

# fixed what-if grid: 5 amounts x 4 vendor ages x 5 no-PO amounts = 100 scenarios
WHATIF_AMOUNTS = [0.0, 25000.0, 50000.0, 100000.0, 200000.0]
WHATIF_DAYS = [0, 7, 30, 90]
WHATIF_NOPO = [0.0, 10000.0, 50000.0, 100000.0, 150000.0]


def _whatif_values_sql() -> str:
    rows, i = [], 0
    for a in WHATIF_AMOUNTS:
        for d in WHATIF_DAYS:
            for p in WHATIF_NOPO:
                rows.append(f"('s{i:05d}', {a}::DOUBLE, {d}, {p}::DOUBLE)")
                i += 1
    return "VALUES " + ", ".join(rows)


WHATIF_SQL = on_scored(f"""
, sc AS (SELECT * FROM ({_whatif_values_sql()}) v(scenario_id, a, d, p)),
x AS (
  SELECT sc.scenario_id, coalesce(s.Amount, 0.0) AS Amount, {RISKY.replace('RiskLevel', 's.RiskLevel')} AS risky,
         (sc.a > 0 AND coalesce(s.Amount, 0.0) >= sc.a) AS dual,
         (sc.d > 0 AND coalesce(CAST(s.VendorAgeDays AS DOUBLE), 9999.0) <= sc.d) AS newv,
         (sc.p > 0 AND coalesce(s.Amount, 0.0) >= sc.p AND s.Rule_MissingPO) AS nopo
  FROM scored s CROSS JOIN sc),
agg AS (
  SELECT scenario_id,
         count(*) FILTER (WHERE risky) AS base_risky_invoices,
         coalesce(sum(CASE WHEN risky THEN CAST(Amount AS DECIMAL(18,4)) END), 0) AS base_amt,
         count(*) FILTER (WHERE risky AND (dual OR newv OR nopo)) AS blocked_risky_invoices,
         coalesce(sum(CASE WHEN risky AND (dual OR newv OR nopo) THEN CAST(Amount AS DECIMAL(18,4)) END), 0) AS blk_amt,
         count(*) FILTER (WHERE dual) AS dual_approval_hits,
         count(*) FILTER (WHERE newv) AS new_vendor_hits,
         count(*) FILTER (WHERE nopo) AS no_po_hits,
         count(*) FILTER (WHERE dual OR newv OR nopo) AS total_policy_hits
  FROM x GROUP BY scenario_id)
SELECT scenario_id, base_risky_invoices, CAST(base_amt AS DOUBLE) AS base_risky_amount,
       blocked_risky_invoices, CAST(blk_amt AS DOUBLE) AS blocked_risk_amount,
       base_risky_invoices - blocked_risky_invoices AS new_risky_invoices,
       CAST(base_amt - blk_amt AS DOUBLE) AS new_risk_amount,
       dual_approval_hits, new_vendor_hits, no_po_hits, total_policy_hits,
       CASE WHEN base_risky_invoices > 0
            THEN CAST(blocked_risky_invoices AS DOUBLE) / base_risky_invoices * 100.0::DOUBLE
            ELSE 0.0 END AS blocked_percentage
FROM agg""").replace("WITH \n", "WITH \n", 1)


@register("what_if", WHATIF_SQL)
def q_what_if(spark, sf):
    sc = policy.scenario_grid(spark, WHATIF_AMOUNTS, WHATIF_DAYS, WHATIF_NOPO)
    return policy.what_if(scored_table(spark, sf), sc)


HEADLINE = f"""
SELECT count(*) FILTER (WHERE {RISKY}) AS risky_invoices,
       count(*) FILTER (WHERE RiskLevel = 'HIGH') AS high_risk_invoices,
       {msum_if(RISKY)} AS risky_amount,
       {msum_if("RiskLevel = 'HIGH'")} AS high_risk_amount,
       count(*) FILTER (WHERE upper(CAST(BankChangeFlag AS VARCHAR)) = 'Y') AS bank_change_count,
       count(*) FILTER (WHERE coalesce(CAST(VendorAgeDays AS DOUBLE), 9999.0) <= 30) AS new_vendor_count,
       count(*) FILTER (WHERE Rule_MissingPO) AS no_po_count,
       count(*) FILTER (WHERE coalesce(Amount, 0.0) >= 95000 AND coalesce(Amount, 0.0) < 100000) AS near_threshold_count,
       count(*) FILTER (WHERE coalesce(Amount, 0.0) >= 100000) AS above_threshold_count
FROM scored"""


@register("playbook_headline", on_scored(
    f"SELECT * EXCLUDE (above_threshold_count) FROM ({HEADLINE})"))
def q_playbook_headline(spark, sf):
    return policy.playbook_headline(scored_table(spark, sf))


def _reco_sql() -> str:
    parts = []
    for rank, cnt, title, prio, impact, reason, action in policy.RECOMMENDATIONS:
        pre, post = reason.split("%d", 1)
        parts.append(
            f"SELECT {rank} AS rank, '{title}' AS title, '{prio}' AS priority, '{impact}' AS impact, "
            f"'{pre}' || CAST({cnt} AS VARCHAR) || '{post}' AS reason, '{action}' AS action "
            f"FROM h WHERE {cnt} > 0")
    return on_scored(f", h AS ({HEADLINE})\n" + "\nUNION ALL\n".join(parts))


@register("playbook_recommendations", _reco_sql())
def q_playbook_recommendations(spark, sf):
    return policy.playbook_recommendations(scored_table(spark, sf))


@register("watchlist_vendors", on_scored(f"""
SELECT coalesce(Vendor, '(Unknown)') AS vendor, count(InvoiceID) AS risky_invoices,
       coalesce({msum('Amount')}, 0.0) AS risky_amount, max(coalesce(RiskScore, 0.0)) AS max_score
FROM scored WHERE {RISKY} GROUP BY Vendor
ORDER BY risky_amount DESC, risky_invoices DESC, vendor LIMIT 5"""))
def q_watchlist_vendors(spark, sf):
    return policy.watchlist_vendors(scored_table(spark, sf))


def _summary_sql() -> str:
    pre, mid = policy.EXEC_TEMPLATE.split("%d", 1)
    mid, post = mid.split("%s", 1)
    wins = ", ".join(f"({i + 1}, '{w}')" for i, w in enumerate(policy.QUICK_WINS))
    return on_scored(f""", h AS ({HEADLINE})
SELECT 'executive_summary' AS kind, 0 AS position,
       '{pre}' || CAST(risky_invoices AS VARCHAR) || '{mid}' || format('{{:,.2f}}', risky_amount) || '{post}' AS text
FROM h
UNION ALL
SELECT 'quick_win', p, t FROM h, (VALUES {wins}) w(p, t)""")


@register("playbook_summary", _summary_sql())
def q_playbook_summary(spark, sf):
    return policy.playbook_summary(scored_table(spark, sf))


# ---- C/D: anomaly model, classifier ---------------------------------------------------------------

@register("anomaly_quantile", on_scored("""
SELECT q AS quantile, n, count(*) FILTER (WHERE Amount >= q) AS flagged
FROM (SELECT quantile_cont(Amount, 0.98) AS q, count(Amount) AS n FROM inv) s, inv
GROUP BY q, n"""))
def q_anomaly_quantile(spark, sf):
    """D3 with Amount as the score: exact interpolated 0.98 quantile and the rows at or above it."""
    from tallyhawk.operators.quantiles import exact_quantile
    inv = invoice_view(spark, sf)
    q = exact_quantile(inv, "Amount", 0.98, name="quantile").select("quantile", F.col("_n").alias("n"))
    return (inv.crossJoin(F.broadcast(q))  # one row
               .groupBy("quantile", "n").agg(F.count(F.when(F.col("Amount") >= F.col("quantile"), 1)).alias("flagged")))


@register("anomaly_flags")
def q_anomaly_flags(spark, sf):
    from tallyhawk.operators.anomaly import run_isolation_forest
    out = run_isolation_forest(invoice_view(spark, sf))
    return out.select("InvoiceID", "ML_AnomalyScore", "ML_IsAnomaly")


@register("fraud_classifier")
def q_fraud_classifier(spark, sf):
    from tallyhawk.operators.classifier import predict_fraud, train_classifier
    inv = invoice_view(spark, sf).select("InvoiceID", "Vendor", "InvoiceNumber", "InvoiceDate", "Amount", "PONumber", "IsFraudLabel")
    model = train_classifier(inv)
    return predict_fraud(model, inv).select("InvoiceID", "IsFraudLabel", F.col("prediction").cast("int").alias("prediction"),
                                            "fraud_probability")
