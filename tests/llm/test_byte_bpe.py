import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from helpers import docs_frame, rng
from pyspark.sql import functions as F

from tallyhawk.llm import byte_bpe
from tallyhawk.llm.sequence_queries import op13_byte_bpe

PARAMS = {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def table():
    return byte_bpe.rank_file(PARAMS["ranks_path"], PARAMS["pattern"])


def plain():
    return tiktoken.Encoding("plain", pat_str=PARAMS["pattern"], mergeable_ranks=table().ranks, special_tokens={})


def odd_texts():
    r = rng(9)
    letters = "ab'sélZ0 9 \n\t\r\x0b\x1c\x1f\x85\xa0 .,!%&中\U0001f600́\x00"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    texts += ["".join(r.choice(kind) for _ in range(r.randint(60, 300))) for kind in ("ab", "aab", "the", "=-", "  \n", "etaoinshr") for _ in range(25)]
    return texts + ["=" * 5001 + "a" * 3000, " " * 4097 + "\n" * 777, "中文字符测试" * 200, "thequickbrownfox" * 100, "0123456789" * 200,
                    "ababa" * 333, "<|endoftext|> x", "", "don't WE'LL"]


def test_ids_and_bytes_of_odd_texts():
    texts, enc = odd_texts(), plain()
    ids = table().encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [enc.encode_ordinary(t) for t in texts]
    assert table().decode(ids) == [t.encode() for t in texts]


def test_small_queries_and_a_small_cache(monkeypatch):
    monkeypatch.setattr(byte_bpe, "QUERY_ROWS", 300)
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 20)
    monkeypatch.setattr(byte_bpe, "BATCH_TOKENS", 50)
    texts, enc, own = odd_texts()[::40] + ["=" * 300 + "xyzzy" * 30], plain(), byte_bpe.RankFile(PARAMS["ranks_path"], PARAMS["pattern"])
    for part in (texts[:20], texts[20:], texts):
        ids = own.encode(part)
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [enc.encode_ordinary(t) for t in part]
        assert own.decode(ids) == [t.encode() for t in part]


def test_merges_follow_rank_then_place():
    """Against contracting one pair at a time in plain Python."""
    own, r = table(), rng(4)

    def contract(word):
        parts = [bytes([b]) for b in word]
        while True:
            ranked = [(own.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in own.ranks]
            if not ranked:
                return [own.ranks[p] for p in parts]
            i = min(ranked)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
    words = ["".join(r.choice("abcdeinrst") for _ in range(r.randint(2, 90))).encode() for _ in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own._encode(words)] == [contract(w) for w in words]


def test_documents(spark):
    texts = [None, "", "A long tail " * 20_000, "same", "same", "x\x00y"]
    docs = docs_frame(spark, texts, ids=[1, 2, 3, 4, 4, None]).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(0))
    enc = plain()
    rows = byte_bpe.encode(docs, **PARAMS)
    got = sorted((x.doc_id or 0, x.n_tokens, bytes(x.ids)) for x in rows.collect())
    want = sorted((i or 0, len(e), np.array(e, "<u4").tobytes()) for i, e in zip([1, 2, 3, 4, 4, None], [enc.encode_ordinary(t or "") for t in texts]))
    assert got == want
    back = sorted((x.doc_id or 0, bytes(x.decoded)) for x in byte_bpe.decode(rows, **PARAMS).collect())
    assert back == sorted((i or 0, (t or "").encode()) for i, t in zip([1, 2, 3, 4, 4, None], texts))
    assert byte_bpe.encode(docs.limit(0), **PARAMS).count() == 0


def test_query(spark, sf):
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    enc = plain()
    rows = op13_byte_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for x in rows:
        ids = enc.encode_ordinary(docs[x.doc_id])
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs[x.doc_id].encode()).hexdigest())
