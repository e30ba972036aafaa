"""Documents (I) and questions (H) on small inline fixtures."""

import pytest
from pyspark.sql import functions as F

from tallyhawk.operators import documents as D
from tallyhawk.operators import questions as Q
from tallyhawk.operators import textmine as T


def test_chunk_boundaries(spark):
    rows = [(n, "x" * n) for n in (0, 700, 701, 1280, 1281)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n for r in df.select("doc_id", F.size(D.chunk_array(F.col("text"))).alias("n")).collect()}
    assert got == {0: 0, 700: 1, 701: 2, 1280: 2, 1281: 3}
    ch = D.build_chunks(df.where("doc_id = 701")).orderBy("chunk_id").collect()
    assert len(ch[0].chunk_text) == 700 and len(ch[1].chunk_text) == 121


def test_reading_time(spark):
    df = spark.createDataFrame([(100,), (300,), (500,)], "w int")
    assert [r.t for r in df.select(T.reading_time(F.col("w")).alias("t")).collect()] == \
        ["1 min read", "2 min read", "2 min read"]


DIRECT = [
    ("what is the tax procedure", "The tax procedure is TAXINN.", "TAXINN"),
    ("what is the approval threshold", "Invoices need approval above INR 50,000.", "INR 50,000"),
    ("which vendor account groups", "Domestic vendors use ZDOM; import vendors use ZIMP.", "Domestic: ZDOM; Import: ZIMP"),
    ("tolerance key", "Tolerance key PP allows 5 percent.", "PP | 5 percent"),
    ("payment terms", "Payment terms Z030 apply.", "Z030"),
    ("inventory posting keys", "Keys BSX and WRX are assigned.", "BSX for inventory posting; WRX for GR/IR clearing"),
    ("does three-way match apply", "Three-way match applies above INR 10,000 only.", "Yes, above INR 10,000"),
]


def test_direct_answers(spark):
    df = spark.createDataFrame(DIRECT, "q string, t string, exp string")
    for r in df.select(D.direct_answer(F.col("q"), F.col("t")).alias("a"), "exp").collect():
        assert r.a == r.exp
    prose = "word " * 60
    fb = spark.createDataFrame([(prose,)], "t string").select(D.fallback_answer(F.col("t")).alias("f")).first().f
    assert fb.endswith("...") and len(fb) <= 223 and not fb[:-3].endswith(" ")


def test_lead_summary(spark):
    df = spark.createDataFrame([(1, "One two three. Four five!  Six?\nSeven."), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in T.lead_summary(df).collect()}
    assert got[1].word_count == 7 and got[1].key_points == ["One two three.", "Four five!", "Six?"]
    assert got[2].word_count == 0 and got[2].key_points == []


QUESTIONS = [
    (1, "show high risk invoices in april 2025"),
    (2, "find invoices with missing po"),
    (3, "invoices from acme steel"),
    (4, "steel pvt invoices"),
    (5, "invoices of kaveri traders"),
    (6, "why was this marked"),
    (7, "show safe invoices of 2024"),
]


@pytest.fixture(scope="module")
def vendors(spark):
    return spark.createDataFrame([("Kaveri Traders",), ("Acme Steel Pvt. Ltd.",), ("Acme",)], "Vendor string")


def test_question_parse(spark, vendors):
    qs = spark.createDataFrame(QUESTIONS, "question_id long, text string")
    got = {r.question_id: r for r in Q.parse_questions(qs, vendors).collect()}
    assert (got[1].risk_level, got[1].month, got[1].year) == ("HIGH", "04", "2025")
    assert got[2].intent == "missing_po"
    assert got[3].vendor == "Acme"
    assert got[4].vendor == "Acme Steel Pvt. Ltd."
    assert got[5].vendor == "Kaveri Traders"
    assert got[6].month is None and got[6].intent == "explain"
    assert (got[7].risk_level, got[7].year) == ("LOW", "2024")
    assert "show" not in got[1].keywords and "april" in got[1].keywords


def test_question_parity_mode(spark, vendors):
    qs = spark.createDataFrame([(6, "why was this marked")], "question_id long, text string")
    r = Q.parse_questions(qs, vendors, parity=True).first()
    assert r.normalized_query == "why was this mard" and r.month == "03"
