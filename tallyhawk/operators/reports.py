"""Reports over the scored invoice table.

Each report is one grouped (or global) aggregate with conditional counts and
exact decimal sums, so it is a single partial/final aggregation over the
scored table; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhawk.functions.columns import (exact_mean, is_high, is_risky, money, money_sum,
                                         money_sum_if, month_label, num_key)
from tallyhawk.operators.risk import level_rank

# fixed values
LEVELS = ["HIGH", "MEDIUM", "LOW", "UNKNOWN"]
UNKNOWN_VENDOR = "(Unknown)"
TOP_RISKY_N = 20
TOP_VENDORS_N = 10
HIST_BINS = 20
STATE_CHART_N = 15
VENDOR_BAND_HIGH = 500000
VENDOR_BAND_MEDIUM = 100000
DISPLAY_COLS = ["InvoiceID", "Vendor", "InvoiceNumber", "InvoiceDate", "Amount", "Currency",
                "PONumber", "RiskLevel", "RiskScore", "RiskReason"]
HISTORY_COLS = ["InvoiceID", "InvoiceNumber", "InvoiceDate", "Amount", "Currency", "PONumber",
                "RiskLevel", "RiskScore"]


def _count_if(cond) -> F.Column:
    return F.count(F.when(cond, F.lit(1)))


def run_summary(scored: DataFrame) -> DataFrame:
    """F1."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        _count_if(is_risky()).alias("risky_invoices"),
        _count_if(is_high()).alias("high_risk_invoices"),
        money_sum_if(is_risky(), "Amount").alias("total_risk_amount"),
        money_sum_if(is_high(), "Amount").alias("high_risk_amount"),
    )


def top_risky_invoices(scored: DataFrame, n: int = TOP_RISKY_N) -> DataFrame:
    """top-n risky rows (TakeOrderedAndProject: a bounded top-k per task)."""
    return (scored.where(is_risky())
                  .orderBy(level_rank().desc(), F.col("RiskScore").desc(),
                           F.col("Amount").desc(), num_key("InvoiceID"))
                  .limit(n).select(*DISPLAY_COLS))


def invoice_lookup(scored: DataFrame, ids: DataFrame) -> DataFrame:
    """display rows for a table of requested ids (``InvoiceID`` column).
    Unknown ids come back with ``found = false``."""
    req = ids.select(F.col("InvoiceID").cast("string").alias("InvoiceID")).distinct()
    hit = scored.select(*DISPLAY_COLS).withColumn("found", F.lit(True))
    return (req.join(hit, "InvoiceID", "left")
               .withColumn("found", F.coalesce("found", F.lit(False))))


def vendor_history(scored: DataFrame, ids: DataFrame) -> DataFrame:
    """every invoice of each focus invoice's vendor (date order, nulls last)."""
    focus = (ids.select(F.col("InvoiceID").cast("string").alias("focus_invoice_id")).distinct()
               .join(scored.select(F.col("InvoiceID").alias("focus_invoice_id"),
                                   F.col("Vendor").alias("_fv")), "focus_invoice_id"))
    hist = scored.select("Vendor", *HISTORY_COLS)
    return (focus.join(hist, focus._fv == hist.Vendor)
                 .select("focus_invoice_id", *HISTORY_COLS)
                 .orderBy("focus_invoice_id", F.col("InvoiceDate").asc_nulls_last(),
                          num_key("InvoiceID")))


def vendor_risk_overview(scored: DataFrame) -> DataFrame:
    """Vendor 360 with risky share, tier and ranking."""
    g = scored.groupBy("Vendor").agg(
        F.count("InvoiceID").alias("total_invoices"),
        F.coalesce(money_sum("Amount"), F.lit(0.0)).alias("total_amount"),
        _count_if(is_risky()).alias("risky_invoices"),
        _count_if(is_high()).alias("high_risk_invoices"),
        exact_mean(F.coalesce(F.col("RiskScore"), F.lit(0.0))).alias("avg_score"),
        F.max(F.coalesce(F.col("RiskScore"), F.lit(0.0))).alias("max_score"),
        F.max("InvoiceDate").alias("_last"),
    )
    pct = F.when(F.col("total_invoices") > 0,
                 F.col("risky_invoices").cast("double") / F.col("total_invoices") * F.lit(100.0)
                 ).otherwise(F.lit(0.0))
    g = g.withColumn("risky_percentage", pct)
    tier = (F.when((F.col("risky_percentage") >= 40) | (F.col("max_score") >= 0.9), "HIGH")
             .when((F.col("risky_percentage") >= 15) | (F.col("max_score") >= 0.7), "MEDIUM")
             .otherwise("LOW"))
    return (g.select(
                F.coalesce(F.col("Vendor"), F.lit(UNKNOWN_VENDOR)).alias("vendor"),
                "total_invoices", "total_amount", "risky_invoices", "high_risk_invoices",
                "risky_percentage", "avg_score", "max_score",
                F.coalesce(F.date_format("_last", "yyyy-MM-dd"), F.lit("NaT")).alias("last_invoice_date"),
                tier.alias("risk_tier"))
             .orderBy(level_rank("risk_tier").desc(), F.col("total_amount").desc(), "vendor"))


def control_summary(scored: DataFrame) -> DataFrame:
    """F8."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        _count_if(is_risky()).alias("risky_invoices"),
        _count_if(is_high()).alias("high_risk_invoices"),
        F.coalesce(money_sum("Amount"), F.lit(0.0)).alias("total_amount"),
        money_sum_if(is_risky(), "Amount").alias("total_risk_amount"),
        money_sum_if(is_high(), "Amount").alias("high_risk_amount"),
    )


def risk_distribution(scored: DataFrame) -> DataFrame:
    """F9 + F19: count per level (four fixed labels) and share of the total."""
    counts = scored.agg(*[_count_if(F.col("RiskLevel") == lv).alias(lv) for lv in LEVELS])
    stack = "stack(4, " + ", ".join(f"'{lv}', `{lv}`" for lv in LEVELS) + ") as (risk_level, count)"
    long = counts.selectExpr(stack)
    total = F.sum("count").over(Window.partitionBy())  # four rows
    return long.withColumn(
        "share", F.col("count").cast("double")
        / F.when(total == 0, F.lit(1)).otherwise(total).cast("double"))


def monthly_trend(scored: DataFrame) -> DataFrame:
    """F10."""
    month = month_label("InvoiceDate") if "InvoiceDate" in scored.columns else F.lit("Unknown")
    return (scored.groupBy(month.alias("month")).agg(
                F.count("InvoiceID").alias("invoices"),
                F.coalesce(money_sum("Amount"), F.lit(0.0)).alias("total_amount"),
                _count_if(is_risky()).alias("risky_invoices"),
                _count_if(is_high()).alias("high_risk_invoices"))
            .orderBy("month"))


def _risky_vendor_agg(scored: DataFrame) -> DataFrame:
    return (scored.where(is_risky()).groupBy("Vendor").agg(
        F.coalesce(money_sum("Amount"), F.lit(0.0)).alias("risky_amount"),
        F.count("InvoiceID").alias("risky_count"),
        F.max(F.coalesce(F.col("RiskScore"), F.lit(0.0))).alias("max_score"))
        .withColumn("vendor", F.coalesce(F.col("Vendor"), F.lit(UNKNOWN_VENDOR))))


def top_risky_vendors(scored: DataFrame, n: int = TOP_VENDORS_N) -> DataFrame:
    """F11."""
    return (_risky_vendor_agg(scored)
            .orderBy(F.col("risky_amount").desc(), "vendor").limit(n)
            .select("vendor", "risky_amount", "risky_count", "max_score"))


def invoice_type_breakdown(scored: DataFrame) -> DataFrame:
    """rows per (InvoiceType, RiskLevel), null groups kept."""
    return scored.groupBy("InvoiceType", "RiskLevel").agg(F.count(F.lit(1)).alias("count"))


def cost_center_breakdown(scored: DataFrame) -> DataFrame:
    """non-null InvoiceID per (CostCenter, RiskLevel)."""
    return scored.groupBy("CostCenter", "RiskLevel").agg(F.count("InvoiceID").alias("count"))


def score_histogram(scored: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """scores rounded to 3 places in ``bins`` equal bins on [0, 1]."""
    s = F.round(F.coalesce(F.col("RiskScore"), F.lit(0.0)), 3)
    b = F.least(F.lit(bins - 1), F.floor(s * bins)).cast("int")
    return (scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
                  .withColumn("bin_start", F.col("bin").cast("double") / F.lit(float(bins)))
                  .select("bin", "bin_start", "count").orderBy("bin"))


def payment_status_breakdown(scored: DataFrame) -> DataFrame:
    """F15."""
    return scored.groupBy("PaymentStatus", "RiskLevel").agg(
        F.count("Amount").alias("count"),
        F.coalesce(money_sum("Amount"), F.lit(0.0)).alias("total_amount"))


def vendor_state_breakdown(scored: DataFrame) -> DataFrame:
    """F16."""
    return (scored.groupBy("VendorState").agg(
                F.count("Amount").alias("total"),
                _count_if(is_risky()).alias("risky"),
                _count_if(is_high()).alias("high_risk"),
                F.coalesce(money_sum("Amount"), F.lit(0.0)).alias("total_amount"),
                money_sum_if(is_risky(), "Amount").alias("risky_amount"))
            .orderBy(F.col("risky").desc(), "VendorState"))


def monthly_amount_split(scored: DataFrame) -> DataFrame:
    """one conditional aggregate instead of three group-bys and two joins."""
    amt = money("Amount")
    total = F.coalesce(F.sum(amt), F.lit(0))
    risky = F.coalesce(F.sum(F.when(is_risky(), amt)), F.lit(0))
    high = F.coalesce(F.sum(F.when(is_high(), amt)), F.lit(0))
    return (scored.groupBy(month_label("InvoiceDate").alias("month"))
                  .agg(total.alias("_t"), risky.alias("_r"), high.alias("_h"))
                  .select("month",
                          F.col("_t").cast("double").alias("total_amount"),
                          F.col("_r").cast("double").alias("risky_amount"),
                          F.col("_h").cast("double").alias("high_amount"),
                          (F.col("_t") - F.col("_r")).cast("double").alias("safe_amount"))
                  .orderBy("month"))


def chart_series(scored: DataFrame) -> DataFrame:
    """derived chart series as one long table (series, label, value, band)."""
    mas = monthly_amount_split(scored).select(
        F.lit("month_medium").alias("series"), F.col("month").alias("label"),
        F.greatest(F.lit(0.0), F.col("risky_amount") - F.col("high_amount")).alias("value"),
        F.lit(None).cast("string").alias("band"))
    bands = F.array(*[F.struct(F.lit(name).alias("series"), v.cast("double").alias("value")) for name, v in [
        ("state_low", F.greatest(F.lit(0), F.col("total") - F.col("risky"))),
        ("state_medium", F.greatest(F.lit(0), F.col("risky") - F.col("high_risk"))),
        ("state_high", F.col("high_risk"))]])
    states = (vendor_state_breakdown(scored)
              .orderBy(F.col("risky").desc(), F.col("VendorState").asc_nulls_first()).limit(STATE_CHART_N)
              .select(F.explode(bands).alias("b"), F.col("VendorState").alias("label"))
              .select("b.series", "label", "b.value", F.lit(None).cast("string").alias("band")))
    tv = top_risky_vendors(scored).select(
        F.lit("vendor_band").alias("series"), F.col("vendor").alias("label"),
        F.col("risky_amount").alias("value"),
        F.when(F.col("risky_amount") > VENDOR_BAND_HIGH, "high")
         .when(F.col("risky_amount") > VENDOR_BAND_MEDIUM, "medium").otherwise("low").alias("band"))
    return mas.unionByName(states).unionByName(tv)


def level_grid(scored: DataFrame, by: str) -> DataFrame:
    """every (by, level) pair with its count, absent pairs as 0."""
    return (scored.groupBy(by).pivot("RiskLevel", ["HIGH", "MEDIUM", "LOW"])
                  .agg(F.count(F.lit(1))).na.fill(0, ["HIGH", "MEDIUM", "LOW"]))
