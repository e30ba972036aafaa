"""DuckDB twins of the registered queries (the correctness oracle).

The driver pre-registers the test tables as views; each text starts from the
same invoice fixture (FIXTURES.md §2) written in DuckDB's dialect.
"""

from __future__ import annotations

FIXTURE = """
inv AS (
SELECT
  CAST(row_number() OVER (ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey,
       l.l_suppkey, l.l_shipdate, l.l_extendedprice, l.l_quantity, l.l_discount,
       l.l_tax) - 1 AS VARCHAR)                                  AS InvoiceID,
  s.s_name                                                       AS Vendor,
  concat('INV-', CAST(l.l_orderkey AS VARCHAR))                  AS InvoiceNumber,
  CASE WHEN l.l_partkey % 211 = 0 THEN NULL
       WHEN l.l_partkey % 5 = 0
         THEN CAST(date_trunc('month', l.l_shipdate) AS TIMESTAMP)
       ELSE CAST(l.l_shipdate AS TIMESTAMP) END                  AS InvoiceDate,
  CASE WHEN l.l_partkey % 97 = 0 THEN -l.l_extendedprice
       WHEN l.l_partkey % 53 = 0 THEN l.l_extendedprice * 4
       WHEN l.l_partkey % 5 = 0
         THEN floor(l.l_extendedprice / 1000) * 1000.0e0
       ELSE l.l_extendedprice END                                AS Amount,
  CASE WHEN s.s_nationkey % 3 = 0 THEN 'USD' ELSE 'INR' END      AS Currency,
  CASE WHEN l.l_partkey % 11 = 0 THEN NULL
       WHEN l.l_partkey % 13 = 0 THEN '  '
       ELSE concat('PO-', CAST(l.l_orderkey AS VARCHAR)) END     AS PONumber,
  concat('CC-', CAST(s.s_nationkey AS VARCHAR))                  AS CostCenter,
  n.n_name                                                       AS VendorState,
  l.l_returnflag                                                 AS InvoiceType,
  l.l_linestatus                                                 AS PaymentStatus,
  CASE WHEN l.l_partkey % 37 = 0 THEN 'Y' ELSE 'N' END           AS BankChangeFlag,
  CAST(date_diff('day', min(l.l_shipdate) OVER (PARTITION BY l.l_suppkey), l.l_shipdate) AS INT)
                                                                 AS VendorAgeDays,
  CASE WHEN l.l_partkey % 53 = 0 OR l.l_partkey % 97 = 0
       THEN 1 ELSE 0 END                                         AS IsFraudLabel
FROM lineitem l
JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN nation   n ON n.n_nationkey = s.s_nationkey
)"""

RULES = """
rules AS (
SELECT i.*,
  count(*) OVER (PARTITION BY Vendor, InvoiceNumber) > 1          AS Rule_ExactDuplicate,
  count(*) OVER (PARTITION BY Vendor, InvoiceDate, Amount) > 1    AS Rule_SoftDuplicate,
  (PONumber IS NULL OR NOT regexp_matches(PONumber, '\\S'))        AS Rule_MissingPO,
  coalesce(Amount <= 0, false)                                    AS Rule_NegativeOrZeroAmount,
  median(Amount) OVER (PARTITION BY Vendor)                       AS VendorMedianAmount
FROM inv i
),
rules2 AS (
SELECT *,
  coalesce(Amount > 3.0::DOUBLE * VendorMedianAmount, false) AS Rule_HighAmountForVendor
FROM rules
),
flagged AS (
SELECT *,
  list_filter([
    CASE WHEN Rule_ExactDuplicate THEN 'Exact duplicate (same vendor & invoice number)' END,
    CASE WHEN Rule_SoftDuplicate THEN 'Soft duplicate (same vendor, date & amount)' END,
    CASE WHEN Rule_HighAmountForVendor THEN 'Amount >> vendor historical median' END,
    CASE WHEN Rule_MissingPO THEN 'Missing PO number' END,
    CASE WHEN Rule_NegativeOrZeroAmount THEN 'Amount is zero or negative' END
  ], lambda x: x IS NOT NULL) AS Rule_Flags
FROM rules2
)"""

SCORED = """
scored0 AS (
SELECT *,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE,
      0.0::DOUBLE
    + CASE WHEN Rule_ExactDuplicate THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN Rule_SoftDuplicate THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN Rule_HighAmountForVendor THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN Rule_MissingPO THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN Rule_NegativeOrZeroAmount THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
    + 0.0::DOUBLE)) AS RiskScore
FROM flagged
),
scored AS (
SELECT *,
  CASE WHEN RiskScore >= 0.7 THEN 'HIGH' WHEN RiskScore >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS RiskLevel,
  CASE WHEN len(Rule_Flags) = 0 THEN 'No strong risk signals detected.'
       ELSE array_to_string(Rule_Flags, '; ') END AS RiskReason
FROM scored0
)"""

BASE = "WITH " + ",".join([FIXTURE, RULES, SCORED])

RISKY = "RiskLevel IN ('HIGH', 'MEDIUM')"


def msum(expr: str) -> str:
    """Exact decimal sum reported as double (our number policy)."""
    return f"CAST(SUM(CAST({expr} AS DECIMAL(18,4))) AS DOUBLE)"


def msum_if(cond: str, expr: str = "Amount") -> str:
    return f"coalesce(CAST(SUM(CASE WHEN {cond} THEN CAST({expr} AS DECIMAL(18,4)) END) AS DOUBLE), 0.0)"


def lvl_rank(c: str) -> str:
    return f"CASE {c} WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 END"


def on_scored(select: str) -> str:
    return f"{BASE}\n{select}"
