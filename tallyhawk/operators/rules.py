"""The five invoice rules and their flag texts.

Duplicate counts are partial aggregates joined back on their own keys (a hot
duplicate group is combined map-side; the join-back is split by AQE skew
handling), and the vendor median is an exact distributed order statistic, so
no vendor ever has to fit in one window task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.functions.columns import blank_text
from tallyhawk.functions.joins import bounded_broadcast, join_null_safe
from tallyhawk.operators.quantiles import group_median
from tallyhawk.session import materialize

# fixed values: flag texts, in the order they are listed on an invoice
FLAG_EXACT = "Exact duplicate (same vendor & invoice number)"
FLAG_SOFT = "Soft duplicate (same vendor, date & amount)"
FLAG_HIGH = "Amount >> vendor historical median"
FLAG_NO_PO = "Missing PO number"
FLAG_NON_POSITIVE = "Amount is zero or negative"
HIGH_AMOUNT_FACTOR = 3.0

EXACT_KEYS = ["Vendor", "InvoiceNumber"]
SOFT_KEYS = ["Vendor", "InvoiceDate", "Amount"]


#: Most repeated keys or medians (some 100 bytes each) that are broadcast to the invoices.
REPEATED_ROWS = 500_000


def repeated_keys(inv: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keys that more than one row holds, with a true column ``name``: few rows, as most keys are held once.

    Written first: while they are few they are then broadcast, and no invoice is shuffled to be marked."""
    held = inv.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    return bounded_broadcast(materialize(held.select(*keys, F.lit(True).alias(name)), "repeated-keys"), REPEATED_ROWS)


def vendor_medians(df: DataFrame) -> DataFrame:
    """Exact median Amount per Vendor (null vendors form no group)."""
    return group_median(df.where(F.col("Vendor").isNotNull()), ["Vendor"], "Amount",
                        "VendorMedianAmount")


def _marked(rows: DataFrame, repeated: DataFrame, keys: list[str], name: str) -> DataFrame:
    return join_null_safe(rows, repeated, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def exact_duplicate(inv: DataFrame) -> DataFrame:
    """B1: same vendor and invoice number on more than one row."""
    return _marked(inv, repeated_keys(inv, EXACT_KEYS, "Rule_ExactDuplicate"), EXACT_KEYS, "Rule_ExactDuplicate")


def soft_duplicate(inv: DataFrame) -> DataFrame:
    """B2: same vendor, date and amount on more than one row."""
    return _marked(inv, repeated_keys(inv, SOFT_KEYS, "Rule_SoftDuplicate"), SOFT_KEYS, "Rule_SoftDuplicate")


def missing_po(inv: DataFrame) -> DataFrame:
    """B3."""
    return inv.withColumn("Rule_MissingPO", blank_text("PONumber"))


def non_positive(inv: DataFrame) -> DataFrame:
    """B4."""
    return inv.withColumn("Rule_NegativeOrZeroAmount", F.coalesce(F.col("Amount") <= 0, F.lit(False)))


def _above_median(rows: DataFrame, medians: DataFrame) -> DataFrame:
    above = F.col("Amount") > F.lit(HIGH_AMOUNT_FACTOR) * F.col("VendorMedianAmount")
    return (rows.join(bounded_broadcast(medians, REPEATED_ROWS), "Vendor", "left")
            .withColumn("Rule_HighAmountForVendor", F.coalesce(above, F.lit(False))))


def high_for_vendor(inv: DataFrame) -> DataFrame:
    """B5 + B6: the vendor's median and amounts far above it."""
    return _above_median(inv, vendor_medians(inv))


def add_rule_columns(inv: DataFrame) -> DataFrame:
    """B1–B6 as columns on every invoice row.

    Counts and medians are taken from ``inv`` itself, not from a table that other rules were
    joined to; three small tables are then joined once each."""
    exact = repeated_keys(inv, EXACT_KEYS, "Rule_ExactDuplicate")
    soft = repeated_keys(inv, SOFT_KEYS, "Rule_SoftDuplicate")
    medians = vendor_medians(inv)
    rows = _marked(inv, exact, EXACT_KEYS, "Rule_ExactDuplicate")
    rows = _marked(rows, soft, SOFT_KEYS, "Rule_SoftDuplicate")
    return _above_median(non_positive(missing_po(rows)), medians)


def flags_array() -> F.Column:
    """Ordered flag texts of one row."""
    parts = [
        F.when(F.col("Rule_ExactDuplicate"), F.lit(FLAG_EXACT)),
        F.when(F.col("Rule_SoftDuplicate"), F.lit(FLAG_SOFT)),
        F.when(F.col("Rule_HighAmountForVendor"), F.lit(FLAG_HIGH)),
        F.when(F.col("Rule_MissingPO"), F.lit(FLAG_NO_PO)),
        F.when(F.col("Rule_NegativeOrZeroAmount"), F.lit(FLAG_NON_POSITIVE)),
    ]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def apply_rule_checks(inv: DataFrame) -> DataFrame:
    return add_rule_columns(inv).withColumn("Rule_Flags", flags_array())
