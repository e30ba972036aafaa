"""The pipeline's stages, one after another, against brute force on the smallest tables."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from helpers import UP, near_components, words
from tokenizers import Tokenizer

from tallyhawk.llm import mixing
from tallyhawk.session import materialize


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    out = []
    for _, stage in corpus_pipeline.STAGES:
        # written apart from the tables that the next stage deletes
        docs = materialize(stage(spark, docs, sf), "pipeline-test")
        out.append(docs)
    clean, exact, near, mixed, packed = out
    assert all(d.columns == columns for d in (clean, exact, near, mixed))
    toxic = {x.doc_id for x in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    every = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {x.doc_id: x.text for x in clean.collect()}
    assert all(every[i] == t for i, t in rows.items())
    assert len(set(every) - set(rows) - toxic) <= 0.02 * len(every)

    last = {}
    for i, t in rows.items():
        t = (t or "").translate(UP)
        last[t] = max(i, last.get(t, i))
    kept = {x.doc_id: x.text for x in exact.collect()}
    assert set(kept) == set(last.values())

    comp, _ = near_components(list(kept.items()), 5)
    single = {x.doc_id: x for x in near.collect()}
    assert set(single) == {i for i, c in comp.items() if i == c}

    plan = {x.doc_id: x.taken for x in mixing.mix(near).collect()}
    got = defaultdict(int)
    pieces = mixed.collect()
    for x in pieces:
        got[x.doc_id] += len(words(x.text))
        assert single[x.doc_id].text.startswith(x.text) and x.source == single[x.doc_id].source
    assert {i: n for i, n in plan.items() if n} == dict(got)

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    whole = {}
    for x in pieces:
        ids = np.array(tok.encode(x.text, add_special_tokens=False).ids + [1], "<u4")
        want[x.doc_id] += len(ids)
        whole.setdefault(x.doc_id, []).append(ids)
    length = defaultdict(int)
    for x in packed.collect():
        length[x.doc_id] += x.length
        assert any(zlib.crc32(a[x.start:x.start + x.length].tobytes()) == x.ids_crc32
                   for a in whole[x.doc_id] if len(a) == x.doc_tokens)
    assert length == want
