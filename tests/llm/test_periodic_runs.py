import hashlib
import zlib

import numpy as np
from helpers import docs_frame, rng, words
from pyspark.sql import functions as F

from tallyhawk.llm import periodic_runs
from tallyhawk.llm.sequence_queries import op11_periodic_runs, with_periodic_tails


def brute(ws, least=12):
    """(start, length, period) of all runs, by comparing words p apart for every p."""
    out = {}
    for p in range(1, len(ws) // 2 + 1):
        i = 0
        while i + p < len(ws):
            start = i
            while i + p < len(ws) and ws[i] == ws[i + p]:
                i += 1
            if i - start + p >= max(least, 2 * p):
                out.setdefault((start, i - start + p), p)
            i += 1
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda x: (x[0], x[2]))


def collapse(ws, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def planted(doc_id, ws):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not ws:
        return ws
    n, g = len(ws), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]


def sample_texts(r):
    texts = []
    for _ in range(150):
        few, n = r.choice([1, 2, 3, 5, 40]), r.choice([0, 1, 5, 12, 40, 160])
        ws = [f"w{r.randint(0, few)}" for _ in range(n)]
        if n > 20 and r.random() < 0.7:
            a, p = r.randrange(n), r.randint(1, 9)
            ws = [ws[i] if i < a else ws[min(n - 1, a + (i - a) % p)] for i in range(n)]
        texts.append(r.choice([" ", "\n", " \t "]).join(ws))
    return texts


def report(doc_id, ws):
    runs = brute(ws)
    best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapse(ws, runs).encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_equal_brute_force(spark):
    texts = [*sample_texts(rng(3)), None, "", " \n", "a a b", "x " * 30, "x " * 30]
    found = {r.doc_id: r for r in periodic_runs.periodic_runs(docs_frame(spark, texts).withColumn("runs", F.lit(1))).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        runs = brute(words(t))
        assert [tuple(x) for x in found[i].runs] == runs
        assert found[i].kept_text == collapse(words(t), runs) and found[i].n_words == len(words(t))


def test_groups_of_documents_and_small_grids(monkeypatch):
    monkeypatch.setattr(periodic_runs, "GRID_PLACES", 50)
    texts = [words(t) for t in sample_texts(rng(4))]
    runs, flags = periodic_runs.runs_of([[w.encode() for w in ws] for ws in texts])
    for i, ws in enumerate(texts):
        assert [tuple(x[1:]) for x in runs.tolist() if x[0] == i] == brute(ws)
        assert " ".join(w for w, gone in zip(ws, flags[i]) if not gone) == collapse(ws, brute(ws))


def test_grammar_spells_its_words_and_extends_exactly():
    r = rng(8)
    row = np.array([9, *(r.choice([1, 1, 1, 2, 3]) for _ in range(600)), 10], np.int64)
    g = periodic_runs.Grammar(row, 9, 10)
    made = {int(n): (int(a), int(b), block) for names, left, right, block in g.rules for n, a, b in zip(names, left, right)}

    def spell(s):
        if s not in made:
            return [s]
        a, b, block = made[s]
        return spell(a) * b if block else spell(a) + spell(b)
    assert len(g.symbols[-1]) == 3 and [x for s in g.symbols[-1].tolist() for x in spell(s)] == row.tolist()
    pairs = [sorted(r.sample(range(1, 601), 2)) for _ in range(4000)]
    a, b = (np.array(x) for x in zip(*pairs))
    ahead, back = g.extend(a, b), g.extend_back(a, b)
    for x, y, n, m in zip(a, b, ahead, back):
        assert (row[x:x + n] == row[y:y + n]).all() and row[x + n] != row[y + n]
        assert (row[x - m:x] == row[y - m:y]).all() and row[x - m - 1] != row[y - m - 1]


def test_a_very_long_text_beside_short_ones(spark):
    r = rng(6)
    start = [f"w{r.randint(0, 500)}" for _ in range(60_000)]
    long = [*start, *(start[-20_000:] * 2), "end"]
    texts = [" ".join(long), "a b c", "z " * 50_000]
    found = {x.doc_id: x for x in periodic_runs.periodic_runs(docs_frame(spark, texts)).collect()}
    assert [tuple(x) for x in found[0].runs if x.period > 100] == [(40_000, 60_000, 20_000)]
    assert found[1].runs == [] and [tuple(x) for x in found[2].runs] == [(0, 50_000, 1)] and found[2].kept_text == "z"


def test_edges(spark):
    rows = docs_frame(spark, ["q " * 15, "q " * 15, None], ids=[None, 7, 7])
    got = periodic_runs.run_report(periodic_runs.periodic_runs(rows)).collect()
    assert sorted((x.doc_id is None, x.n_runs) for x in got) == [(False, 0), (False, 1), (True, 1)]
    assert all(x.runs_sha256 is not None for x in got)
    assert periodic_runs.run_report(periodic_runs.periodic_runs(rows.limit(0))).count() == 0


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {x.doc_id: tuple(x[c] for c in COLUMNS) for x in op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    some = [d for d in docs if len(words(d.text)) < 600]
    assert len(some) > 100 and any(got[d.doc_id][1] for d in some)
    for d in some:
        assert got[d.doc_id] == report(d.doc_id, planted(d.doc_id, words(d.text)))


def test_planted_tails(spark):
    texts = ["a b c d e f g h"] * 60 + [None, "", "one"]
    got = {x.doc_id: x.text for x in with_periodic_tails(docs_frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert words(got[i]) == planted(i, words(t))
