import math
from collections import Counter, defaultdict

from helpers import DOCS, prose, rng

from tallyhawk.llm import quality


def brute_model(texts, order=5):
    """Interpolated modified Kneser-Ney by dictionaries: a function gram → log-probability."""
    counts = {order: Counter(g for t in texts for w in t.split() for g in quality._grams(w))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    levels = {}
    for k, c in counts.items():
        t = Counter(min(n, 5) for n in c.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + t[2] else None
        d = {}
        for m in (1, 2, 3):
            ok = t[m] > 0 and y is not None
            d[m] = min(max(m - (m + 1) * y * t[m + 1] / t[m], 0.05), m - 0.05) if ok else 0.5 * m
        total, cuts = Counter(), defaultdict(float)
        for g, n in c.items():
            total[g[:-1]] += n
            cuts[g[:-1]] += d[min(n, 3)]
        levels[k] = (c, d, total, cuts)

    def logp(gram):
        p = 1 / (len(counts[1]) + 1)
        for k in range(1, order + 1):
            c, d, total, cuts = levels[k]
            g = gram[order - k:]
            h = g[:-1]
            a = (c[g] - d[min(c[g], 3)]) / total[h] if c[g] else 0.0
            p = a + (cuts[h] / total[h] if total[h] else 1.0) * p
        return math.log(p)
    return logp


def test_scores_equal_the_dictionary_model(spark):
    r = rng(12)
    good = [prose(r, 40, 60) for _ in range(40)]
    texts = good + ["", None, "%%% $$$ ###", "unseen wörds", "y" * 2000, good[0], "x"]
    langs = ["en"] * (len(texts) - 2) + [None, "zz"]
    rows = [(i, t, l, "s", 0) for i, (t, l) in enumerate(zip(texts, langs))]
    df = spark.createDataFrame(rows + [(None, "w1 w2", "en", "s", 0)], DOCS).repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(40)] + [(None,)], "doc_id long")
    got = {x.doc_id: x for x in quality.quality(df, trusted, quantile=0.99).collect()}
    logp = brute_model(good)
    for i, t in enumerate(texts[:-2]):
        want = sum(logp(g) for w in (t or "").split() for g in quality._grams(w))
        assert abs(got[i].logp - want) < 1e-6 and got[i].n_chars == sum(len(w) + 1 for w in (t or "").split())
    assert sum(got[i].kept for i in range(40)) >= 39 and not got[42].kept
    assert got[40].kept and got[41].kept and got[None].logp < 0                  # nothing to score
    assert got[len(texts) - 1].kept and got[len(texts) - 1].perplexity is None   # no trusted text
    assert quality.quality(spark.createDataFrame([], DOCS), trusted).count() == 0


def test_probabilities_sum_to_one(spark):
    r = rng(13)
    texts = [prose(r, 30, 30) for _ in range(20)]
    df = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    model = quality.kneser_ney(df)
    letters = {g for t in texts for w in t.split() for g in w} | {quality.END}
    for context in ("\x02\x02\x02w", "\x02w12", "zzzz"):
        grams = spark.createDataFrame([("en", context + c) for c in sorted(letters) + ["?"]], "lang string, gram string")
        assert abs(sum(math.exp(x.logp) for x in quality.gram_scores(grams, model).collect()) - 1) < 1e-9
