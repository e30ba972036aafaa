"""Distributed helpers against brute force: ordinal, order statistics, top-k, TextRank, forest."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


def test_ordinal_contiguous(spark):
    from tallyhawk.operators.ordinal import with_ordinal
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.integers(0, 50, 3000), "b": rng.permutation(3000)})
    df = spark.createDataFrame(pdf)
    for parts in (1, 8):
        got = with_ordinal(df, ["a", "b"], "o", partitions=parts).toPandas().sort_values("o")
        exp = pdf.sort_values(["a", "b"]).reset_index(drop=True)
        assert list(got.o) == list(range(3000))
        assert (got[["a", "b"]].to_numpy() == exp.to_numpy()).all()


def test_order_statistics_with_hot_group(spark):
    from tallyhawk.operators.quantiles import exact_quantile, group_median
    rng = np.random.default_rng(2)
    g = np.where(rng.random(5000) < 0.5, "hot", rng.choice(list("abcdef"), 5000))
    v = np.round(rng.normal(100, 30, 5000), 2)
    pdf = pd.DataFrame({"g": g, "v": v})
    df = spark.createDataFrame(pdf)
    med = {r.g: r.median for r in group_median(df, ["g"], "v").collect()}
    for k, grp in pdf.groupby("g"):
        s = np.sort(grp.v.to_numpy())
        n = len(s)
        assert med[k] == (s[(n - 1) // 2] + s[n // 2]) / 2
    q = exact_quantile(df, "v", 0.98, name="q").first().q
    assert abs(q - np.quantile(v, 0.98)) < 1e-9


def test_cosine_topk_matches_brute_force(spark):
    from tallyhawk.operators.vectors import cosine_topk
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(400, 16)).astype(np.float32)
    queries = rng.normal(size=(7, 16))
    cdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(corpus)],
                                "vec_id long, embedding array<float>").repartition(5)
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)],
                                "query_id long, query_vec array<double>")
    got = cosine_topk(qdf, cdf, k=5).toPandas()
    c = corpus.astype(np.float64)
    sims = (queries @ c.T) / np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(c, axis=1))
    for q in range(7):
        exp = list(np.argsort(-sims[q], kind="stable")[:5])
        assert list(got[got.query_id == q].sort_values("rank").match_id) == exp


def test_textrank_equals_dense(spark):
    from tallyhawk.operators import textmine as T
    docs = spark.createDataFrame([
        (1, "Invoices arrive daily. Vendors send invoices by mail. Payments follow approval. "
            "Approval needs two managers. Managers review vendors monthly."),
        (2, "Audit checks payments. Payments need approval. Audit reports go to managers."),
    ], "doc_id long, text string")
    sents = T.sentences(docs)
    got = T.textrank(sents).toPandas()
    w = T.tfidf(sents).toPandas()
    for d in (1, 2):
        n = sents.where(F.col("doc_id") == d).count()
        vecs = [dict(zip(g.term, g.weight)) for _, g in
                w[w.doc_id == d].groupby("sent_id")] if True else []
        ids = sorted(w[w.doc_id == d].sent_id.unique())
        vec = {i: dict(zip(w[(w.doc_id == d) & (w.sent_id == i)].term, w[(w.doc_id == d) & (w.sent_id == i)].weight))
               for i in ids}
        sim = np.zeros((n, n))
        for i in range(n):
            for j in range(n):
                if i != j and i in vec and j in vec:
                    keys = set(vec[i]) & set(vec[j])
                    if keys:
                        dot = sum(vec[i][k] * vec[j][k] for k in keys)
                        sim[i, j] = dot / (np.linalg.norm(list(vec[i].values())) * np.linalg.norm(list(vec[j].values())))
        rs = sim.sum(axis=1, keepdims=True)
        sim = np.where(rs > 0, sim / np.where(rs > 0, rs, 1), sim)
        r = np.full(n, 1.0 / n)
        for _ in range(60):
            new = 0.15 / n + 0.85 * sim.T @ r
            if np.max(np.abs(new - r)) < 1e-4:
                break
            r = new
        mine = got[got.doc_id == d].sort_values("sent_id").score.to_numpy()
        assert np.allclose(mine, r, atol=1e-12)
        assert mine.sum() <= 1.0 + 1e-9


def test_forest_flags_two_percent_and_outliers(spark):
    from tallyhawk.operators.anomaly import run_isolation_forest
    rng = np.random.default_rng(4)
    n = 2000
    amounts = np.round(rng.normal(1000, 50, n), 2)
    amounts[:10] = 100000.0  # planted outliers
    pdf = pd.DataFrame({"InvoiceID": [str(i) for i in range(n)], "Vendor": rng.choice(["A", "B", "C"], n),
                        "Amount": amounts, "InvoiceDate": pd.Timestamp("2025-01-01")})
    df = spark.createDataFrame(pdf).withColumn("InvoiceDate", F.col("InvoiceDate").cast("timestamp_ntz"))
    out = run_isolation_forest(df, trees=50).toPandas()
    assert 0.02 <= out.ML_IsAnomaly.mean() <= 0.03
    assert out.set_index("InvoiceID").loc[[str(i) for i in range(10)], "ML_IsAnomaly"].all()
    again = run_isolation_forest(df.repartition(7), trees=50).toPandas()
    assert (out.sort_values("InvoiceID").ML_IsAnomaly.to_numpy()
            == again.sort_values("InvoiceID").ML_IsAnomaly.to_numpy()).all()


def test_days_since_last_hot_vendor(spark):
    from tallyhawk.operators.features import days_since_last
    rng = np.random.default_rng(5)
    n = 3000
    vendor = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c"], n))
    dates = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 400, n), unit="D") \
        + pd.to_timedelta(rng.integers(0, 86400, n), unit="s")
    dates = pd.Series(dates).where(rng.random(n) > 0.05)
    pdf = pd.DataFrame({"InvoiceID": [str(i) for i in range(n)], "Vendor": vendor, "InvoiceDate": dates})
    df = spark.createDataFrame(pdf).withColumn("InvoiceDate", F.col("InvoiceDate").cast("timestamp_ntz"))
    got = days_since_last(df, partitions=8).toPandas().set_index("InvoiceID").DaysSinceLastInvoice
    pdf["idn"] = pdf.InvoiceID.astype(int)
    s = pdf.sort_values(["Vendor", "InvoiceDate", "idn"], na_position="last")
    prev = s.groupby("Vendor").InvoiceDate.shift()
    exp = ((s.InvoiceDate - prev).dt.total_seconds() // 86400).fillna(999).astype(int)
    exp.index = s.InvoiceID
    assert (got.loc[exp.index].to_numpy() == exp.to_numpy()).all()
