from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from helpers import DOCS, docs_frame, prose, rng, words

from tallyhawk.llm import substring_dedup


def brute(rows, k):
    first = defaultdict(lambda: float("inf"))
    big = float("inf")
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - k + 1):
            g = tuple(w[p:p + k])
            first[g] = min(first[g], big if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p:p + k])] < (big if i is None else i):
                gone.update(range(p, p + k))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("k,block,shard", [(3, 400, 50), (13, 4_000_000, 2_000_000), (13, 900, 100)])
def test_removed_words_match_brute_force(spark, monkeypatch, k, block, shard):
    monkeypatch.setattr(substring_dedup, "AUTOMATON_ANCHORS", 8)
    r = rng(6)
    passage = prose(r, 60)
    texts = ["", None, "one", " ".join(["run"] * 50), " ".join(["run"] * 30), passage, passage, passage.upper()]
    for _ in range(60):
        w = prose(r, r.randint(0, 40), 60).split()
        at = r.randint(0, len(w))
        if r.random() < 0.6:
            cut = r.randint(0, 40)
            w[at:at] = passage.split()[cut:cut + r.randint(5, 20)]
        texts.append("\t\n".join(w) if r.random() < 0.3 else "  ".join(w))
    ids = [*range(100, 100 + len(texts) - 3), None, 7, 7]
    df = docs_frame(spark, texts, ids=ids, partitions=4)
    got = substring_dedup.drop_repeated_passages(df, window=k, block_bytes=block, shard_windows=shard).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got), key=str) == brute(list(zip(ids, texts)), k)


def test_empty_table(spark):
    assert substring_dedup.drop_repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_windows_that_share_the_upper_half_of_a_hash(monkeypatch):
    """Upper halves narrowed to 8 bits, so that most keys of a shard would meet by them."""
    whole = substring_dedup.Block.__init__

    def narrow(self, pdf, window):
        whole(self, pdf, window)
        self.hash = (self.hash & np.uint64(0xFFFFFFFF)) | (self.hash >> np.uint64(56) << np.uint64(32))
    monkeypatch.setattr(substring_dedup.Block, "__init__", narrow)
    r, k, shards = rng(8), 13, 2
    shared = [prose(r, r.randint(13, 16), 5000) for _ in range(150)]
    rows = [(i, " ".join([prose(r, 20, 5000), shared[i % 150], prose(r, 20, 5000)])) for i in range(450)]
    r.shuffle(rows)
    blocks = [pd.DataFrame(rows[b::6], columns=["doc_id", "text"]).assign(no_id=False) for b in range(6)]
    sent = pd.concat([substring_dedup._send_hashes(p, b, shards, k) for b, p in enumerate(blocks)])
    asked = pd.concat([substring_dedup._find_recurring(p, s) for s, p in sent.groupby("shard")])
    passages = pd.concat([substring_dedup._send_passages(p, asked[asked["block"] == b], k) for b, p in enumerate(blocks)])
    got = pd.concat([substring_dedup._locate(p, passages[passages["block"] == b], k) for b, p in enumerate(blocks)])
    assert sorted(zip(got["doc_id"], got["n_words"], got["n_removed"], got["kept_text"]), key=str) == brute(rows, k)
