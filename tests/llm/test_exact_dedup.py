import hashlib
from collections import defaultdict

import pytest
from helpers import DOCS, UP, docs_frame, prose, rng
from pyspark.sql import functions as F

from tallyhawk.llm import exact_dedup


def brute(rows, keep=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UP)].append(i)
    return {(i, keep(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}


@pytest.mark.parametrize("hot_rows", [3, 500])
def test_groups_match_brute_force(spark, hot_rows):
    r = rng(3)
    lead = "the same long beginning of many texts "
    texts = ["", None, "", "É", "é", "ABC", "abc", lead * 300, lead * 300 + "x", lead * 300]
    texts += ["copy of copies"] * 40 + ["Copy OF copies"] * 25 + [lead + prose(r, 3, 5) for _ in range(80)]
    df = docs_frame(spark, texts, partitions=5)
    got = exact_dedup.exact_groups(df, hot_rows=hot_rows, rows_per_range=20).collect()
    assert {(x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got} == brute(enumerate(texts))
    assert len(got) == len(texts) and all(x.kept == (x.doc_id == x.keep_id) for x in got)
    least = exact_dedup.exact_groups(df, keep="smallest", hot_rows=hot_rows).collect()
    assert {(x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in least} == brute(enumerate(texts), min)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    df = docs_frame(spark, ["a", "a", "b", "a"], ids=[5, 5, None, 4], partitions=2) \
        .withColumn("keep_id", F.lit("x")).withColumn("salt", F.lit(0)).withColumn("h", F.lit(1))
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns
    assert sorted((x.doc_id or -1, x.text) for x in left.collect()) == [(-1, "b"), (5, "a")]
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOCS)).count() == 0
