from collections import defaultdict

from helpers import DOCS, docs_frame, prose, rng, words
from pyspark.sql import functions as F

from tallyhawk.llm import mixing

EDGE = ["", None, "a b c", " \t\n", "one", "x" * 5000 + " y", "a b c", "A  b\nc d"]


def reshared(sizes, weights, cap=3):
    """Share by weight, stop at the cap, share the excess again until none is above."""
    total, out, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while True:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        w = sum(weights[i] for i in free)
        over = [i for i in free if w and rest * weights[i] / w >= cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = rest * weights[i] / w if w else 0.0
            return out
        for i in over:
            out[i] = cap * sizes[i]
            free.discard(i)


def test_budgets_are_met_exactly(spark):
    r = rng(1)
    sources = [["a", "b", "c", None, "hot"][min(4, r.randint(0, 9))] for _ in range(300)]
    texts = EDGE + [prose(r, r.randint(1, 40)) for _ in range(292)]
    df = docs_frame(spark, texts, sources=sources)
    got = mixing.mix(df, range_rows=16).collect()
    assert len(got) == 300
    size = defaultdict(int)
    for t, s in zip(texts, sources):
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(order, reshared([size[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))])))
    taken = defaultdict(int)
    for row in got:
        s = sources[row.doc_id]
        assert row.size == len(words(texts[row.doc_id])) and row.source_size == size[s]
        assert abs(row.target - want[s]) < 1e-6 and 0 <= row.taken <= 3 * row.size
        taken[s] += row.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in order)
    again = mixing.mix(df.repartition(7), range_rows=64).collect()
    assert sorted(got) == sorted(again)


def test_targets_stop_at_the_cap(spark):
    df = docs_frame(spark, ["a " * 10, "b " * 90, "c " * 4], sources=["x", "y", "z"])
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert got[2].target == 12.0 and got[2].taken == 12          # weight 3, but only 4 words
    assert abs(sum(r.target for r in got.values()) - 104) < 1e-9


def test_mixed_documents_hold_the_planned_words(spark):
    r = rng(2)
    df = docs_frame(spark, EDGE + [prose(r, r.randint(1, 30)) for _ in range(60)]) \
        .withColumn("size", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("key", F.lit(None).cast("int"))
    plan = mixing.mix(df).groupBy().agg(F.sum("taken")).first()[0]
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    rows = mixed.collect()
    assert sum(len(words(x.text)) for x in rows) == plan
    whole = {x.doc_id: x.text for x in df.collect()}
    assert all(whole[x.doc_id].startswith(x.text) and x.n_chars == len(x.text) for x in rows)


def test_weights_table_and_empty_input(spark):
    df = docs_frame(spark, ["a b"] * 6, sources=["x", "x", "x", "y", "y", "y"])
    w = spark.createDataFrame([("x", 1), ("y", 0)], "source string, weight int")
    got = {r.doc_id: r.taken for r in mixing.mix(df, weights=w).collect()}
    assert sum(got[i] for i in (0, 1, 2)) == 12 and sum(got[i] for i in (3, 4, 5)) == 0
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
