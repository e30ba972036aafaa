"""Plans and results that must hold as tables grow."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from tallyhawk.operators import textmine as T


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def exchanges(df) -> int:
    return len(re.findall(r"^\W*Exchange ", plan(df), re.M))


TEXTS = [(1, "Red fox runs. Blue fox sleeps! A red sky, a blue sky. And?"), (2, "One line only"), (3, ""), (4, None),
         (5, "Cats chase mice. Dogs chase cats. Mice fear cats and dogs. Birds sing.")]


def _sents(spark, rows=TEXTS):
    return T.sentences(spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id"))


def test_terms_of_documents_are_shuffled_once(spark):
    sents = _sents(spark)
    w = T.tfidf(sents)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(4, "doc_id")
    for df, most in ((w, 1), (T.sentence_similarity(w), 1), (T.textrank(sents), 1), (T.keywords(docs, sents), 2)):
        assert exchanges(df) <= most
        df.collect()


def test_similarity_equals_pairs(spark):
    w = T.tfidf(_sents(spark))
    ids = w.select("doc_id", "sent_id").distinct()
    pairs = ids.withColumnRenamed("sent_id", "i").join(ids.withColumnRenamed("sent_id", "j"), "doc_id").where("i <> j")
    cos = {(r.doc_id, r.i, r.j): r.cosine for r in T.pair_similarity(w, pairs).collect()}
    got = {(r.doc_id, r.sent_id): r for r in T.sentence_similarity(w).collect()}
    assert set(got) == {(r.doc_id, r.sent_id) for r in ids.collect()}
    for (d, i), r in got.items():
        assert abs(r["mass"] - sum(c for (a, b, _), c in cos.items() if (a, b) == (d, i))) < 1e-9
        assert abs((r.next_sim or 0.0) - cos.get((d, i, i + 1), 0.0)) < 1e-9


def test_ranks_without_an_id(spark):
    rows = TEXTS + [(None, "No id. No rank?")]
    sents = _sents(spark, rows)
    assert T.tfidf(sents).where(F.col("doc_id").isNull()).count() == 0
    one = {(r.doc_id, r.sent_id): r.score for r in T.textrank(sents).where("doc_id is not null").collect()}
    joined = {(r.doc_id, r.sent_id): r.score for r in T.textrank_joined(sents).collect()}
    assert one.keys() == joined.keys() and all(abs(one[k] - joined[k]) < 1e-9 for k in one)


def test_tiles_of_many_queries_and_ties(monkeypatch):
    import numpy as np
    import pandas as pd

    from tallyhawk.operators import vectors as V
    monkeypatch.setattr(V, "LEAST_TILE", 16)
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    c = rng.normal(size=(200, 24)) * rng.integers(1, 9, size=(200, 1))
    c[50:60], c[70] = c[3], 0.0
    q = np.vstack([rng.normal(size=(20, 24)), c[3], np.zeros(24)])
    for normalise in (True, False):
        got = V._tile_topk(pd.DataFrame({"qid": np.arange(len(q)), "qv": list(q)}), pd.DataFrame({"cid": np.arange(200), "cv": list(c)}), 5, normalise)
        scores = (q[:, None, :] * c[None]).sum(axis=2)
        if normalise:
            den = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1))
            scores = scores / np.where(den == 0, 1e-10, den)
        for i in range(len(q)):
            want = sorted(range(200), key=lambda j: (-round(scores[i, j], 9), j))[:5]
            assert got[got.query_id == i].sort_values(["score", "match_id"], ascending=[False, True]).match_id.tolist() == want
    assert V.QUERY_TILE >= 32768   # the corpus is shuffled once for as many queries


def test_phrases_stay_with_their_document(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(4, "doc_id")
    assert exchanges(T.key_phrases(docs)) <= 1


def test_ranks_by_rounds_of_repeated_sentences(spark):
    sents = _sents(spark, [(7, "Red fox runs. Blue fox sleeps. A green sky."), (7, "Red fox runs. Blue fox sleeps. A green sky.")])
    got = {r.sent_id: r.score for r in T.textrank_joined(sents, rounds=1, tol=0.0).distinct().collect()}
    # a round adds a sentence's own rank once too often; the third sentence shares no term with others
    w = {(r.sent_id, r.term): r.weight for r in T.tfidf(sents).collect()}
    norm = {i: sum(x * x for (j, _), x in w.items() if j == i) ** 0.5 for i in range(3)}
    u = {k: x / norm[k[0]] for k, x in w.items()}
    mass = {i: sum(x * sum(y for (j, s), y in u.items() if s == t and j != i) for (k, t), x in u.items() if k == i) for i in range(3)}
    v = {i: (1 / 6 / mass[i] if mass[i] > 0 else 0.0) for i in range(3)}
    held = {t: sum(2 * x * v[i] for (i, s), x in u.items() if s == t) for _, t in u}
    for i in range(3):
        flow = sum(x * held[t] for (k, t), x in u.items() if k == i) - v[i] if mass[i] > 0 else 0.0
        assert abs(got[i] - (0.15 / 6 + 0.85 * flow)) < 1e-9
