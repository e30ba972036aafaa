"""Tests of the third pass over round 3: what a block of passages computes, what a batch of quality sends."""

import numpy as np
import pandas as pd
import pytest

from tallyhawk.llm import quality, substring_dedup


def test_block_codes_words_once():
    texts = ["a b a\x0bb a b", "", None, "é b \U0001F600 a b a", "\x85x \xa0 a b a b", "a b a b a b \ud800"]
    pdf = pd.DataFrame({"doc_id": [5, 1, 2, 2, 9, 3], "no_id": False, "text": texts})
    b = substring_dedup.Block(pdf, 2)
    assert "number" not in vars(b)   # no dictionary of words unless passages came from other blocks
    order = np.argsort(pdf["doc_id"].to_numpy(), kind="stable")
    words = [(texts[i] or "").encode("utf-8", "surrogatepass").split() for i in order]
    assert b.words == sum(words, []) and b.counts.tolist() == [len(w) for w in words]
    assert [b.vocabulary[c] for c in b.codes] == b.words and len(set(b.vocabulary)) == len(b.vocabulary)
    assert b.number == {w: i for i, w in enumerate(dict.fromkeys(b.words))}
    seen = {}
    for at, key in enumerate(b.hash.tolist()):
        seen.setdefault(key, []).append(at)
    h, first, twice = b.firsts()
    assert h.tolist() == sorted(seen) and first.tolist() == [seen[k][0] for k in h.tolist()]
    assert twice.tolist() == [len({int(b.ids[b.doc[a]]) for a in seen[k]}) > 1 for k in h.tolist()]
    empty = substring_dedup.Block(pdf.iloc[1:3], 2)
    assert [len(x) for x in empty.firsts()] == [0, 0, 0] and empty.words == []


def test_batch_parts_agree(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)
    monkeypatch.setattr(quality, "TaskContext", Task)
    monkeypatch.setattr(quality, "BATCH_BYTES", 40)
    texts = ["one two  two", "", "\t\n", " é one\x1cone", "a" * 50, "two \x85 one", " one"]
    pdf = pd.DataFrame({"doc_id": range(7), "no_id": [False] * 6 + [True], "lang": ["x", "x", "y", "x", "x", "", "x"],
                        "text": texts})
    docs, words, uses = (pd.concat(quality._ask([pdf, pdf.head(2)], 5, part)) for part in ("docs", "words", "uses"))
    assert list(docs.columns) == ["batch", "lang", "uses"] and docs["batch"].is_unique and set(uses["batch"]) <= set(docs["batch"])
    want = {}
    for row in [*pdf.itertuples(), *pdf.head(2).itertuples()]:
        want.setdefault(row.lang, []).append((row.doc_id, row.no_id, sum(len(w) + 1 for w in row.text.split())))
    got = {}
    for lang, blob in zip(docs["lang"], docs["uses"]):
        got.setdefault(lang, []).extend(zip(*np.frombuffer(blob, np.int64).reshape(3, -1).tolist()))
    assert got == want
    held = lambda m: {(s, x, w) for s, x, b in zip(m["shard"], m["lang"], m["words"]) for w in quality._words(b)}
    assert held(words) == held(uses) == {(s, x, w) for s, x, w in held(uses) if w}
    assert {(x, w) for _, x, w in held(uses)} == {(r.lang, w) for r in pdf.itertuples() for w in r.text.split()}
    total = 0
    for batch, blob, b in zip(uses["batch"], uses["words"], uses["uses"]):
        raw = np.frombuffer(quality._unzip(b), np.uint8).reshape(3, -1)
        doc, word, n = (np.ascontiguousarray(p.reshape(4, -1).T).view("<u4").ravel().astype(int) for p in raw)
        assert word.max() < len(quality._words(blob)) and np.cumsum(doc).max() < 7
        total += n.sum()
    assert total == sum(len(t.split()) for t in [*texts, *texts[:2]])


@pytest.mark.parametrize("shards", [1, 70000])
def test_homes_hold_every_place_once(shards):
    home = quality._homes([f"w{i}" for i in range(500)], shards)
    parts = [(s, at.tolist()) for s, at in quality._by_home(home)]
    assert [s for s, _ in parts] == sorted(set(home.tolist()))
    assert parts == [(s, np.flatnonzero(home == s).tolist()) for s, _ in parts]
