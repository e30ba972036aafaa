import zlib

from helpers import DOCS, docs_frame, prose, rng
from pyspark.sql import functions as F

from tallyhawk.llm import toxicity


def corpus(spark, n=400):
    r = rng(21)
    texts, labels = [], []
    for i in range(n):
        w = prose(r, r.randint(20, 80)).split()
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            w.insert(r.randint(0, len(w)), r.choice(["you moron", "id1ots", "scum!!", "your trash"]))
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    return docs_frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_rows_are_told_apart(spark):
    docs, labels, truth = corpus(spark)
    got = toxicity.toxicity(docs, labels, trees=8).collect()
    assert len(got) == 400
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)
    held = [x for x in got if x.held_out]
    assert sum(x.predicted == truth[x.doc_id] for x in held) / len(held) > 0.95


def test_held_out_labels_are_never_used(spark):
    docs, labels, _ = corpus(spark, 200)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic"))
                                .otherwise(F.col("toxic")))
    score = lambda l: sorted((x.doc_id, x.score) for x in toxicity.toxicity(docs, l, trees=3).collect())
    assert score(labels) == score(flipped)


def test_odd_rows_and_clashing_columns(spark):
    docs, labels, _ = corpus(spark, 160)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "w1", "en", "s", 2),
                                 (9003, "Moron you " * 20_000, "en", "s", 0), (9002, "", "en", "s", 0)], DOCS)
    both = docs.union(odd).withColumn("score", F.lit("mine")).withColumn("hits", F.lit(2 ** 60 + 1))
    got = toxicity.toxicity(both, labels, trees=3).collect()
    assert len(got) == 165 and all(x.score is not None for x in got)
    left = toxicity.drop_toxic(both, labels, trees=3)
    assert left.columns == both.columns
    rows = left.where("doc_id is null or doc_id >= 9000").collect()
    assert {x.doc_id for x in rows} == {None, 9001, 9002} and all(x.hits == 2 ** 60 + 1 and x.score == "mine" for x in rows)
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), labels, trees=2).count() == 0
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {x.score for x in none} == {0.0}
