"""Tests of the third pass over the findings of round 3."""

from pyspark.sql import functions as F

from tallyhawk.operators import documents as D
from tallyhawk.operators import vectors as V


def _windows(text, size, overlap):
    t = text.strip()
    if len(t) <= size:
        return [t] if t else []
    out, at = [], 0
    while True:
        out.append(t[at:at + size].strip())
        if at + size >= len(t):
            return [x for x in out if x]
        at += size - overlap


def test_chunks_read_the_text_once_and_stay_the_same(spark):
    odd = "ab\U0001F600\n é d  x"
    texts = [(odd * n)[:m].strip() for n, m in
             ((1, 0), (1, 5), (300, 579), (300, 580), (300, 581), (300, 699), (300, 700), (300, 701), (300, 1160), (300, 1279),
              (300, 1280), (300, 1281), (300, 1860), (300, 1861), (300, 2900))] + [" " * 900, "a" + " " * 2000 + "b", "\n" + "w " * 2500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id long, text string")
    for size, overlap in ((700, 120), (10, 0), (10, 5), (10, 8)):
        got = {r.id: r.c for r in df.select("id", D.chunk_array(F.col("text"), size, overlap).alias("c")).collect()}
        assert got == {-1: [], **{i: _windows(t, size, overlap) for i, t in enumerate(texts)}}
    plan = df.select(D.chunk_array(F.col("text")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.split("\n")[0].count("text#") == 1     # a second one would be evaluated for every window


def test_embed_text_counts_words_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b
    rows = [(i, t) for i, t in enumerate(["red red blue", "", "blue sky über", "Red-sky 42", "red"] * 8)]
    df = spark.createDataFrame(rows, "id long, text string")
    once = V.embed_text(df.mapInArrow(seen, df.schema)).collect()
    assert reads.value == len(rows)
    want = V.embed_with(V.fit_embedding(df), df)
    assert {r.id: (r.text, r.embedding) for r in once} == {r.id: (r.text, r.embedding) for r in want.collect()}
