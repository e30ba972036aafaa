"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built and forced with the ``noop`` writer (full execution, no
output); one warm-up, then the median of $BENCH_RUNS runs. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tallyhawk.plans.catalog import QUERIES  # noqa: E402
from tallyhawk.session import build_session  # noqa: E402

HEADLINE = ["risk_scores", "vendor_risk_overview", "monthly_amount_split", "what_if", "anomaly_flags",
            "cosine_topk", "doc_chunks", "doc_tfidf", "question_matches", "intake_ids"]


def skewed_risk_scores(spark, sf):
    """risk_scores with half of all invoices moved onto one vendor (skew test)."""
    from tallyhawk.operators.risk import score_invoices
    from tallyhawk.sources.fixtures import invoice_view
    inv = invoice_view(spark, sf)
    inv = inv.withColumn("Vendor", F.when(F.col("InvoiceID").cast("long") % 2 == 0, F.lit("Supplier#HOT"))
                         .otherwise(F.col("Vendor")))
    return score_invoices(inv).select("InvoiceID", "Vendor", "Amount", "RiskScore", "RiskLevel", "RiskReason")


def fixture_build(spark, sf):
    """Building the invoice table from the star schema (ids by a distributed ordinal)."""
    from tallyhawk.sources.fixtures import build_invoice_view
    return build_invoice_view(spark, sf)


def timed(spark, fn, sf):
    t = time.perf_counter()
    fn(spark, sf).write.mode("overwrite").format("noop").save()
    return time.perf_counter() - t


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "24g")})
    queries = {name: QUERIES[name] for name in (only or HEADLINE) if name in QUERIES}
    if not only or "risk_scores_skew" in only:
        queries["risk_scores_skew"] = skewed_risk_scores
    if not only or "invoice_fixture" in only:
        queries["invoice_fixture"] = fixture_build
    results = {}
    for name, fn in queries.items():
        timed(spark, fn, sf_dir)  # warm-up
        results[name] = round(statistics.median(timed(spark, fn, sf_dir) for _ in range(runs)), 3)
        print(f"# {name}: {results[name]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "sum_of_median_query_sec", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": sf, "cpus": int(cpus), "runs": runs,
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
