"""Weighted risk score, level and written reason; ``score_invoices``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.operators.rules import apply_rule_checks

# fixed values: weights in the order they are added, thresholds, texts
WEIGHTS = [
    ("Rule_ExactDuplicate", 0.45),
    ("Rule_SoftDuplicate", 0.3),
    ("Rule_HighAmountForVendor", 0.2),
    ("Rule_MissingPO", 0.1),
    ("Rule_NegativeOrZeroAmount", 0.1),
    ("ML_IsAnomaly", 0.25),
]
HIGH_THRESHOLD = 0.7
MEDIUM_THRESHOLD = 0.4
ML_REASON = "ML model marked this invoice as anomalous based on historical patterns"
NO_REASON = "No strong risk signals detected."
LEVEL_ORDER = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def _flag(df: DataFrame, name: str) -> F.Column:
    # an absent column counts as false
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def risk_score_col(df: DataFrame) -> F.Column:
    total = F.lit(0.0)
    for name, w in WEIGHTS:
        total = total + F.when(_flag(df, name), F.lit(w)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def risk_level_col(score="RiskScore") -> F.Column:
    s = F.col(score)
    return (F.when(s >= HIGH_THRESHOLD, "HIGH")
             .when(s >= MEDIUM_THRESHOLD, "MEDIUM").otherwise("LOW"))


def risk_reason_col(df: DataFrame) -> F.Column:
    flags = F.col("Rule_Flags") if "Rule_Flags" in df.columns else F.array().cast("array<string>")
    reasons = F.concat(F.coalesce(flags, F.array().cast("array<string>")),
                       F.when(_flag(df, "ML_IsAnomaly"), F.array(F.lit(ML_REASON)))
                        .otherwise(F.array().cast("array<string>")))
    return F.when(F.size(reasons) == 0, F.lit(NO_REASON)).otherwise(F.array_join(reasons, "; "))


def add_risk_scores(df: DataFrame) -> DataFrame:
    return (df.withColumn("RiskScore", risk_score_col(df))
              .withColumn("RiskLevel", risk_level_col())
              .withColumn("RiskReason", risk_reason_col(df)))


def level_rank(level="RiskLevel") -> F.Column:
    return (F.when(F.col(level) == "HIGH", 3).when(F.col(level) == "MEDIUM", 2)
             .when(F.col(level) == "LOW", 1))


def score_invoices(inv: DataFrame, ml: bool = False, **forest_kw) -> DataFrame:
    """Rules, optional isolation-forest flag, then score / level / reason."""
    df = apply_rule_checks(inv)
    if ml:
        from tallyhawk.operators.anomaly import run_isolation_forest
        df = run_isolation_forest(df, **forest_kw)
    return add_risk_scores(df)
