import numpy as np
import pytest
from helpers import DOCS, docs_frame, near_components, prose, rng

from tallyhawk.llm import near_dedup


def variants(r, base, n, changes):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randint(0, changes)):
            w[r.randrange(len(w))] = f"v{r.randint(0, 10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,block", [(2, 4096), (5, 16)])
def test_components_match_all_pairs(spark, k, block):
    r = rng(8)
    texts = ["", None, " \n", "One", "one", "one two", "x" * 3000, "x" * 3000]
    texts += variants(r, prose(r, 120), 60, 9)                 # a hot group, some of it barely linked
    chain = prose(r, 200).split()
    for i in range(12):                                        # each near the next, ends far apart
        chain = chain[8:] + prose(r, 8).split()
        texts.append(" ".join(chain))
    for _ in range(25):
        texts += variants(r, prose(r, r.randint(3, 150)), 2, 4)
    df = docs_frame(spark, texts, partitions=4)
    got = near_dedup.near_groups(df, words=k, block_docs=block).collect()
    comp, sizes = near_components(list(enumerate(texts)), k)
    assert len(got) == len(texts)
    assert {x.doc_id: x.component_id for x in got} == comp
    assert {x.doc_id: x.n_shingles for x in got} == sizes
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)
    kept = near_dedup.keep_one_each(df, words=k)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, c in comp.items() if i == c)


def test_pigeonhole_finds_every_pair_within_the_radius():
    g = np.random.RandomState(0)
    a = g.randint(0, 65536, (300, 48)).astype(np.uint16)
    b = a.copy()
    for i in range(300):
        at = g.choice(48, near_dedup.RADIUS, replace=False)
        b[i, at] += 1
    ka, kb = near_dedup.index_keys(a), near_dedup.index_keys(b)
    assert all(np.intersect1d(x, y).size for x, y in zip(ka, kb))


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = docs_frame(spark, ["a b c"] * 4, ids=[3, 3, None, 5])
    got = sorted((x.doc_id or -1, x.component_id, x.kept) for x in near_dedup.near_groups(df).collect())
    assert got == [(-1, None, True), (3, 3, True), (3, 3, True), (5, 3, False)]
    assert near_dedup.near_groups(spark.createDataFrame([], DOCS)).count() == 0
