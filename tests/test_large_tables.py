"""Plans and results that must hold for tables much larger than the test data."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyhawk.operators import anomaly, rules


def _invoices(spark, rows):
    return spark.createDataFrame(rows, "InvoiceID string, Vendor string, InvoiceNumber string, InvoiceDate timestamp_ntz, "
                                       "Amount double, PONumber string")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_mark_invoices_without_shuffling_them(spark):
    rows = [(str(i), None if i % 7 == 0 else f"V{i % 3}", None if i % 11 == 0 else f"N{i % 20}", None, float(i % 5), "x") for i in range(60)]
    inv = _invoices(spark, rows)
    out = rules.add_rule_columns(inv)
    assert "Exchange hashpartitioning" not in _plan(out) and "SortMergeJoin" not in _plan(out)
    exact, soft = Counter(r[1:3] for r in rows), Counter(r[1:5:3] for r in rows)
    got = {r["InvoiceID"]: (r["Rule_ExactDuplicate"], r["Rule_SoftDuplicate"]) for r in out.collect()}
    assert got == {r[0]: (exact[r[1:3]] > 1, soft[r[1:5:3]] > 1) for r in rows}


def test_many_repeated_keys_are_joined_all_the_same(spark, monkeypatch):
    rows = [(str(i), f"V{i % 4}", f"N{i % 30}", None, float(i % 9), None) for i in range(80)]
    few = {tuple(r) for r in rules.add_rule_columns(_invoices(spark, rows)).collect()}
    monkeypatch.setattr(rules, "REPEATED_ROWS", 1)
    assert {tuple(r) for r in rules.add_rule_columns(_invoices(spark, rows)).collect()} == few


def test_invoices_are_numbered_as_narrow_rows_that_no_lookup_shuffled(spark, sf, monkeypatch):
    from tallyhawk.sources import fixtures
    seen, number = [], fixtures.with_ordinal

    def numbered(df, *args):
        seen.append(df)
        return number(df, *args)
    monkeypatch.setattr(fixtures, "with_ordinal", numbered)
    fixtures.build_invoice_view(spark, sf)
    assert "Exchange hashpartitioning" not in _plan(seen[0])
    assert "s_name" not in seen[0].columns and "n_name" not in seen[0].columns


def test_a_repeated_supplier_key_gives_an_invoice_for_each_of_its_rows(spark, sf, tmp_path):
    from tallyhawk.sources import fixtures
    for name in ("nation", "lineitem"):
        fixtures.table(spark, sf, name).limit(40).write.parquet(f"{tmp_path}/{name}.parquet")
    sup = fixtures.table(spark, sf, "supplier")
    sup.union(sup.withColumn("s_name", F.concat("s_name", F.lit(" B")))).write.parquet(f"{tmp_path}/supplier.parquet")
    got = fixtures.build_invoice_view(spark, str(tmp_path)).select(F.col("InvoiceID").cast("int"), "Vendor").collect()
    assert sorted(r[0] for r in got) == list(range(80))
    assert sum(r[1].endswith(" B") for r in got) == 40


def test_names_are_normalised_once_for_each_vendor_not_for_each_invoice(spark):
    from tallyhawk.operators.questions import _vendor_names
    rows = [(str(i), None if i % 5 == 0 else ["Acme Ltd.", " ACME  ltd", "..."][i % 3], None, None, 1.0, None) for i in range(40)]
    names = _vendor_names(_invoices(spark, rows))
    assert "regexp_replace" in _plan(names) and "HashAggregate" not in _plan(names)
    assert sorted(tuple(r) for r in names.collect()) == [(" ACME  ltd", "acme ltd", 10), ("Acme Ltd.", "acme ltd", 9)]


def _walk(forest, X):
    """Path lengths node by node."""
    total = np.zeros(len(X))
    for t in range(len(forest["feature"])):
        for i, x in enumerate(X):
            n = 0
            while not forest["leaf"][t, n]:
                n = forest["left" if x[forest["feature"][t, n]] < forest["threshold"][t, n] else "right"][t, n]
            total[i] += forest["depth"][t, n] + anomaly.avg_path(forest["size"][t, n])
    return total


def test_filled_trees_give_the_path_lengths_of_a_walk(spark):
    rng = np.random.default_rng(3)
    points = [(str(i), [float(v) for v in rng.integers(0, 40, 3)]) for i in range(300)]
    forest = anomaly.fit_isolation_forest(spark.createDataFrame(points, "key string, x array<double>"), trees=7)
    X = np.vstack([[p[1] for p in points], [[np.nan, 1, 2], [50, -1, np.inf]], rng.normal(20, 9, (anomaly.SCORE_BLOCK, 3))])
    filled = anomaly._complete_trees(forest)
    assert (anomaly._path_sums(X, *filled) == _walk(forest, X)).all()
    one = anomaly.fit_isolation_forest(spark.createDataFrame(points[:1], "key string, x array<double>"), trees=2)
    assert (anomaly._path_sums(X, *anomaly._complete_trees(one)) == _walk(one, X)).all()
