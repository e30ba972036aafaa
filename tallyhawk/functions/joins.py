"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join where null keys match each other (pandas group semantics).
    Spark plans ``<=>`` keys as ordinary hash / sort-merge join keys."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])


def bounded_broadcast(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows`` narrow rows, else as it is (a
    shuffle join). ``df`` should read a written table: it is counted here."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
