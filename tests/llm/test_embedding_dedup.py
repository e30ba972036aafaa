import numpy as np
import pytest
from helpers import components

from tallyhawk.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    ok = [(i, np.asarray(v, float), l) for i, v, l in rows
          if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and np.any(np.asarray(v, float))]
    links = []
    for x, (i, v, l) in enumerate(ok):
        for j, w, m in ok[x + 1:]:
            if l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links.append((i, j))
    n = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    c = components([i for i, _, _ in rows], links)
    return {(i, n[i], c[i], c[i] == i) for i, _, _ in rows}


@pytest.mark.parametrize("small,window", [(2048, 128), (8, 16)])
def test_links_match_all_pairs(spark, monkeypatch, small, window):
    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    g = np.random.RandomState(1)
    rows, n = [], 0

    def add(v, label):
        nonlocal n
        rows.append((n, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label))
        n += 1
    for noise, count in ((0.02, 40), (0.12, 40), (0.0, 20), (0.16, 12)):
        centre = g.randn(32)
        for _ in range(count):
            add(centre + noise * g.randn(32), 1)
    for _ in range(150):
        add(g.randn(32), int(g.randint(0, 3)))
    for v, label in ((None, 1), ([], 1), ([0.0] * 32, 1), ([float("nan")] * 32, 1), ([None] * 32, 1),
                     ([float("inf")] + [1.0] * 31, 1), ([1.0] * 32, None), ([1.0] * 32, None), ([1.0] * 5, 1)):
        add(v, label)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = embedding_dedup.embedding_groups(df, window=window).collect()
    assert {(x.vec_id, x.n_links, x.component_id, x.kept) for x in got} == brute(rows)
    assert len(got) == len(rows)


def test_empty_table(spark):
    assert embedding_dedup.embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("count,labels", [(200, 10), (1000, 10)])
def test_links_do_not_depend_on_the_number_of_partitions(spark, count, labels):
    g = np.random.RandomState(2)
    rows = []
    for k in range(count // 2):
        v = g.randn(64)
        for i in (k, count - 1 - k):
            rows.append((i, [float(np.float32(x)) for x in v + 0.1 * g.randn(64)], k % labels))
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = embedding_dedup.embedding_groups(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(x.vec_id, x.n_links, x.component_id, x.kept) for x in got} == brute(rows)


def test_no_link_is_missed_in_a_dense_label(spark):
    g, n, mutual = np.random.RandomState(4), 4000, 0.86
    centre = np.eye(48)[0]
    noise = g.randn(n, 48) * (np.arange(48) > 0)
    x = np.sqrt(mutual) * centre + np.sqrt(1 - mutual) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    x[-600:] = x[0] + 1e-3 * g.randn(600, 48)     # near copies
    x = x.astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    a, b = np.nonzero(np.triu(near))
    component = components(range(n), list(zip(a.tolist(), b.tolist())))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_groups(df).collect()}
    assert got == {i: (int(near[i].sum()), component[i]) for i in range(n)}
