"""Registered queries: intake (A), features (C), export."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhawk.operators import export, features
from tallyhawk.plans.oracle_sql import BASE, FIXTURE
from tallyhawk.plans.registry import register
from tallyhawk.sources import intake
from tallyhawk.sources.fixtures import invoice_view, raw_invoice_text, table

RAW_SQL = "WITH " + FIXTURE + """,
raw AS (
SELECT CAST(InvoiceID AS BIGINT) AS src_row,
  CASE WHEN CAST(InvoiceID AS BIGINT) % 101 = 3 THEN NULL ELSE Vendor END AS Vendor,
  CASE WHEN CAST(InvoiceID AS BIGINT) % 103 = 5 THEN 'NA' ELSE InvoiceNumber END AS InvoiceNumber,
  CASE WHEN CAST(InvoiceID AS BIGINT) % 89 = 1 THEN 'not a date'
       WHEN CAST(InvoiceID AS BIGINT) % 7 = 0 THEN strftime(InvoiceDate, '%-m/%-d/%Y')
       ELSE strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') END AS InvoiceDate,
  CASE WHEN CAST(InvoiceID AS BIGINT) % 97 = 2 THEN printf('%.2f', Amount) || 'f'
       WHEN CAST(InvoiceID AS BIGINT) % 109 = 4 THEN format('{:,.2f}', Amount)
       ELSE printf('%.2f', Amount) END AS Amount,
  Currency, PONumber, CostCenter, VendorState, InvoiceType, PaymentStatus, BankChangeFlag,
  CAST(VendorAgeDays AS VARCHAR) AS VendorAgeDays, CAST(IsFraudLabel AS VARCHAR) AS IsFraudLabel
FROM inv),
na AS (
SELECT src_row,
  CASE WHEN Vendor IN ({na}) THEN NULL ELSE Vendor END AS Vendor,
  CASE WHEN InvoiceNumber IN ({na}) THEN NULL ELSE InvoiceNumber END AS InvoiceNumber,
  InvoiceDate AS date_txt, Amount AS amount_txt,
  CASE WHEN Currency IN ({na}) THEN NULL ELSE Currency END AS Currency,
  CASE WHEN PONumber IN ({na}) THEN NULL ELSE PONumber END AS PONumber,
  CostCenter, VendorState, InvoiceType, PaymentStatus, BankChangeFlag,
  CAST(TRY_CAST(VendorAgeDays AS DOUBLE) AS INT) AS VendorAgeDays,
  CAST(TRY_CAST(IsFraudLabel AS DOUBLE) AS INT) AS IsFraudLabel
FROM raw),
coerced AS (
SELECT * EXCLUDE (date_txt, amount_txt),
  coalesce(try_strptime(trim(date_txt), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(date_txt), '%m/%d/%Y'))
    AS InvoiceDate,
  CASE WHEN regexp_full_match(amount_txt, '{num}')
            AND NOT isnan(TRY_CAST(trim(amount_txt) AS DOUBLE))
       THEN TRY_CAST(trim(amount_txt) AS DOUBLE) END AS Amount
FROM na),
clean AS (
SELECT * FROM coerced WHERE Vendor IS NOT NULL AND InvoiceNumber IS NOT NULL AND Amount IS NOT NULL)
""".replace("{na}", ", ".join("'" + t.replace("'", "''") + "'" for t in intake.NA_TEXTS)).replace(
    "{num}", intake.NUMBER_PATTERN.replace("^", "").replace("$", ""))


def _canonical(spark, sf):
    return intake.canonicalise(raw_invoice_text(spark, sf))


@register("intake_alias", RAW_SQL + """
SELECT src_row, Vendor, InvoiceNumber, Currency, PONumber, CostCenter FROM raw""")
def q_intake_alias(spark, sf):
    return _canonical(spark, sf).select(F.col("_src_row").alias("src_row"), "Vendor", "InvoiceNumber",
                                        "Currency", "PONumber", "CostCenter")


@register("intake_coerce", RAW_SQL + """
SELECT src_row, InvoiceDate, Amount, VendorAgeDays FROM coerced""")
def q_intake_coerce(spark, sf):
    return intake.coerce(_canonical(spark, sf)).select(
        F.col("_src_row").alias("src_row"), "InvoiceDate", "Amount", "VendorAgeDays")


@register("intake_clean", RAW_SQL + """
SELECT src_row, Vendor, InvoiceNumber, InvoiceDate, Amount, Currency, PONumber, BankChangeFlag
FROM clean""")
def q_intake_clean(spark, sf):
    return intake.drop_unusable(intake.coerce(_canonical(spark, sf))).select(
        F.col("_src_row").alias("src_row"), "Vendor", "InvoiceNumber", "InvoiceDate", "Amount",
        "Currency", "PONumber", "BankChangeFlag")


@register("intake_ids", RAW_SQL + """
SELECT CAST(row_number() OVER (ORDER BY src_row) - 1 AS VARCHAR) AS InvoiceID, src_row, Vendor, Amount
FROM clean""")
def q_intake_ids(spark, sf):
    ids = intake.load_invoice_table(raw_invoice_text(spark, sf), ["_src_row"], keep_source=True)
    return ids.select("InvoiceID", F.col("_src_row").alias("src_row"), "Vendor", "Amount")


@register("intake_report", RAW_SQL + """
SELECT count(*) AS rows, (SELECT count(*) FROM clean) AS kept, count(*) FILTER (WHERE Vendor IS NULL) AS no_vendor,
       count(*) FILTER (WHERE InvoiceNumber IS NULL) AS no_number, count(*) FILTER (WHERE Amount IS NULL) AS no_amount,
       count(*) FILTER (WHERE InvoiceDate IS NULL) AS no_date, CAST(0 AS BIGINT) AS amount_out_of_range
FROM coerced""")
def q_intake_report(spark, sf):
    return intake.intake_report(raw_invoice_text(spark, sf))


ROW_SENTENCE_SQL = RAW_SQL + """
SELECT src_row,
  'Invoice ' || coalesce(InvoiceNumber, 'nan') || ' from ' || coalesce(Vendor, 'nan') || ' dated '
  || coalesce(InvoiceDate, 'nan') || ' amount '
  || coalesce(Amount, 'nan')
  || ' ' || coalesce(Currency, 'nan') || ' has status ' || coalesce(PaymentStatus, 'nan') || '.' AS sentence
FROM raw"""


@register("row_sentences", ROW_SENTENCE_SQL)
def q_row_sentences(spark, sf):
    from tallyhawk.operators.documents import row_sentences
    raw = raw_invoice_text(spark, sf)
    names, chosen = intake.canonical_names(raw.columns)
    df = raw.toDF(*names).select(F.col("_src_row").alias("src_row"),
                                 *[F.col(f"`{c}`") for c in names if c != "_src_row"])
    return row_sentences(df).select("src_row", "sentence")


@register("doc_type_gate", """
SELECT page_id, file_name, ext, ext IN ('pdf', 'docx', 'pptx', 'txt', 'md', 'csv', 'xlsx', 'xls') AS supported
FROM (SELECT page_id, file_name,
        CASE WHEN contains(file_name, '.') THEN lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) ELSE '' END AS ext
      FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*((/[^?#]*)?)', 1) AS path FROM pages) p,
           LATERAL (SELECT regexp_extract(path, '([^/]*)$', 1) AS file_name) f)""")
def q_doc_type_gate(spark, sf):
    from tallyhawk.operators.documents import file_type_gate
    pages = table(spark, sf, "pages")
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*((/[^?#]*)?)", 1)
    files = pages.select("page_id", F.regexp_extract(path, r"([^/]*)$", 1).alias("file_name"))
    return file_type_gate(files, "file_name").select("page_id", "file_name", "ext", "supported")


# ---- C: features --------------------------------------------------------------------

@register("anomaly_features", BASE + """,
vs AS (SELECT Vendor, CAST(sum(CAST(coalesce(Amount, 0.0) AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_a,
              coalesce(stddev_samp(coalesce(Amount, 0.0)), 0.0) AS std_a, count(*) AS cnt
       FROM inv WHERE Vendor IS NOT NULL GROUP BY Vendor)
SELECT InvoiceID, coalesce(i.Amount, 0.0) AS Amount, round(coalesce(avg_a, 0.0), 6) AS VendorAvgAmount,
       round(coalesce(std_a, 0.0), 6) AS VendorStdAmount, coalesce(cnt, 0) AS VendorTxnCount,
       coalesce(isodow(InvoiceDate) - 1, -1) AS InvoiceDayOfWeek
FROM inv i LEFT JOIN vs USING (Vendor)""")
def q_anomaly_features(spark, sf):
    f = features.anomaly_features(invoice_view(spark, sf))
    return f.select("InvoiceID", F.col("Amount_f").alias("Amount"),
                    F.round("VendorAvgAmount", 6).alias("VendorAvgAmount"),
                    F.round("VendorStdAmount", 6).alias("VendorStdAmount"),
                    "VendorTxnCount", "InvoiceDayOfWeek")


@register("behaviour_features", BASE + """,
vs AS (SELECT Vendor, count(InvoiceNumber) AS VendorInvoiceCount,
              CAST(sum(CAST(Amount AS DECIMAL(18,4))) AS DOUBLE) / count(Amount) AS VendorAvgAmount
       FROM inv GROUP BY Vendor)
SELECT InvoiceID, round(CASE WHEN Amount <= 0 THEN 0.0 ELSE ln(Amount) END, 9) AS LogAmount,
       VendorInvoiceCount, round(VendorAvgAmount, 6) AS VendorAvgAmount,
       (PONumber IS NOT NULL AND PONumber <> '') AS HasPO,
       coalesce(Amount > 3.0::DOUBLE * VendorAvgAmount, false) AS HighValueInvoice
FROM inv LEFT JOIN vs USING (Vendor)""")
def q_behaviour_features(spark, sf):
    inv = invoice_view(spark, sf)
    out = features.behaviour_features(inv)
    return out.select("InvoiceID", F.round("LogAmount", 9).alias("LogAmount"), "VendorInvoiceCount",
                      F.round("VendorAvgAmount", 6).alias("VendorAvgAmount"), "HasPO", "HighValueInvoice")


@register("days_since_last", BASE + """
SELECT InvoiceID, Vendor, InvoiceDate,
  coalesce(CAST(floor(date_diff('second',
      lag(InvoiceDate) OVER (PARTITION BY Vendor ORDER BY InvoiceDate ASC NULLS LAST, CAST(InvoiceID AS BIGINT)),
      InvoiceDate) / 86400) AS BIGINT), 999) AS DaysSinceLastInvoice
FROM inv""")
def q_days_since_last(spark, sf):
    return features.days_since_last(invoice_view(spark, sf)).select(
        "InvoiceID", "Vendor", "InvoiceDate", "DaysSinceLastInvoice")


# ---- J1: export ---------------------------------------------------------------------

@register("ledger_export", BASE + """
SELECT InvoiceNumber AS BELNR, InvoiceDate AS BUDAT, Currency AS WAERS, Vendor AS LIFNR,
       Amount AS DMBTR, PONumber AS EBELN, CostCenter AS KOSTL FROM inv""")
def q_ledger_export(spark, sf):
    return export.ledger_export(invoice_view(spark, sf))
