"""Small inputs and brute-force versions shared by the tests."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def docs_frame(spark, texts, ids=None, sources=None, partitions=3):
    rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else f"s{i % 3}", len(t) if t is not None else None)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(partitions)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


def rng(seed=5):
    return random.Random(seed)


def components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text, k):
    w = [x.translate(UP) for x in words(text)]
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def near_components(rows, k):
    """rows: (id, text) → id → component, by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                links.append((a, b))
    return components(ids, links), {i: len(s) for i, s in sets.items()}
