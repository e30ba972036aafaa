"""Column-expression helpers shared by every operator (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RISKY_LEVELS = ("HIGH", "MEDIUM")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Amounts up to 24 digits before the point and six after; sums get 32 digits.
MONEY_TYPE = "decimal(30,6)"


def money(c) -> Column:
    """Amount as exact decimal so sums do not depend on row order; null if out of range."""
    return col(c).try_cast(MONEY_TYPE)


def out_of_money_range(c) -> Column:
    """True for an amount that ``money`` cannot hold, and so leaves out of sums."""
    return col(c).isNotNull() & money(c).isNull()


def money_sum(c) -> Column:
    """Order-independent sum of a money column, reported as double."""
    return F.sum(money(c)).cast("double")


def money_sum_if(cond: Column, c) -> Column:
    return F.coalesce(F.sum(F.when(cond, money(c))).cast("double"), F.lit(0.0))


def exact_mean(c) -> Column:
    """Mean with an exact decimal sum divided by the count (double)."""
    return money_sum(c) / F.count(col(c))


def is_risky(level="RiskLevel") -> Column:
    return col(level).isin(*RISKY_LEVELS)


def is_high(level="RiskLevel") -> Column:
    return col(level) == "HIGH"


def blank_text(c) -> Column:
    """Null, or nothing but (unicode) whitespace after stripping."""
    return F.coalesce(~col(c).rlike(r"(?U)\S"), F.lit(True))


def strip(c) -> Column:
    """Strip unicode whitespace at both ends (Spark ``trim`` only strips spaces)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def month_label(ts) -> Column:
    """Calendar month as ``yyyy-MM``; a missing date is the group ``NaT``."""
    return F.coalesce(F.date_format(col(ts), "yyyy-MM"), F.lit("NaT"))


def num_key(c) -> Column:
    """Numeric sort key for text ids such as InvoiceID."""
    return col(c).cast("long")
