"""Intake (A), rules (B) and scores (E) on the hand-made edge table."""

import os

import pytest
from pyspark.sql import functions as F

from tallyhawk.operators.risk import score_invoices
from tallyhawk.sources import intake

EDGE_CSV = """Supplier,Invoice No,Invoice_Date,Gross Amount,Curr,PO
A,I-1,2025-04-01,100,INR,PO-1
A,I-1,2025-04-02,110,INR,PO-1
,I-9,2025-04-02,10,INR,PO-9
A,I-2,2025-04-03,100,INR,"  "
A,I-3,2025-04-03,100,INR,PO-3
A,I-7,2025-04-03,"1,234",INR,PO-3
A,I-4,not a date,500,INR,PO-4
A,I-5,,120,INR,PO-5
A,I-6,2025-04-04,1.5f,INR,PO-5
B,J-1,,0,USD,PO-6
B,J-2,,0,USD,PO-7
B,,2025-04-05,5,USD,PO-7
C,K-1,2025-12-31,-50,USD,PO-8
"""

EXPECTED = {  # InvoiceID -> (InvoiceNumber, score, level)
    "0": ("I-1", 0.45, "MEDIUM"), "1": ("I-1", 0.45, "MEDIUM"), "2": ("I-2", 0.4, "MEDIUM"),
    "3": ("I-3", 0.3, "LOW"), "4": ("I-4", 0.2, "LOW"), "5": ("I-5", 0.0, "LOW"),
    "6": ("J-1", 0.4, "MEDIUM"), "7": ("J-2", 0.4, "MEDIUM"), "8": ("K-1", 0.30000000000000004, "LOW"),
}


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("edge")
    p = os.path.join(d, "invoices.csv")
    with open(p, "w") as f:
        f.write(EDGE_CSV)
    return intake.load_invoices(spark, p)


def test_edge_ids_and_drops(edge):
    rows = {r.InvoiceID: r for r in edge.collect()}
    assert sorted(rows, key=int) == [str(i) for i in range(9)]
    assert {k: r.InvoiceNumber for k, r in rows.items()} == {k: v[0] for k, v in EXPECTED.items()}
    assert rows["4"].InvoiceDate is None and rows["5"].InvoiceDate is None
    assert rows["2"].PONumber == "  "


def test_edge_scores(edge):
    scored = {r.InvoiceID: r for r in score_invoices(edge).collect()}
    for k, (_, score, level) in EXPECTED.items():
        assert scored[k].RiskScore == score, k
        assert scored[k].RiskLevel == level, k
    assert scored["4"].Rule_HighAmountForVendor and scored["4"].VendorMedianAmount == 105.0
    assert scored["8"].Rule_HighAmountForVendor and scored["8"].Rule_NegativeOrZeroAmount
    assert scored["6"].Rule_SoftDuplicate  # null dates match each other
    assert scored["5"].RiskReason == "No strong risk signals detected."
    assert scored["2"].RiskReason == "Soft duplicate (same vendor, date & amount); Missing PO number"


def test_headers():
    names, chosen = intake.canonical_names([" Vendor ", "Invoice No", "date", "Amount", "Curr", "PO"])
    assert names[0] == "Vendor" and chosen["InvoiceDate"] == "InvoiceDate"
    names, chosen = intake.canonical_names(["Supplier", "Vendor", "Invoice No", "date", "Amount", "Curr", "PO"])
    assert names[:2] == ["Vendor", "Vendor_1"] and chosen["Vendor"] == "Vendor"
    names, chosen = intake.canonical_names(["Vendor", "Invoice No", "date", "Amount_net", "Amount", "Curr", "PO"])
    assert chosen["Amount"] == "Amount"
    with pytest.raises(ValueError, match="Vendor"):
        intake.canonical_names(["vendor_name", "Invoice No", "date", "Amount", "Curr", "PO"])
    assert intake.accept_file("a.CSV") and not intake.accept_file("a.pdf")
    with pytest.raises(ValueError):
        intake.read_invoices(None, "x.docx")


def test_score_lattice(spark):
    import itertools
    names = ["Rule_ExactDuplicate", "Rule_SoftDuplicate", "Rule_HighAmountForVendor", "Rule_MissingPO",
             "Rule_NegativeOrZeroAmount", "ML_IsAnomaly"]
    rows = list(itertools.product([False, True], repeat=6))
    df = spark.createDataFrame(rows, ", ".join(f"{n} boolean" for n in names))
    from tallyhawk.operators.risk import add_risk_scores
    out = add_risk_scores(df.withColumn("Rule_Flags", F.array().cast("array<string>")))
    counts = {r.RiskLevel: r["count"] for r in out.groupBy("RiskLevel").count().collect()}
    assert counts == {"HIGH": 33, "MEDIUM": 20, "LOW": 11}
