import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from helpers import DOCS, docs_frame, prose, rng
from tokenizers import Tokenizer

from tallyhawk.llm import packing
from tallyhawk.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_the_tokenizer():
    r, plain, enc = rng(9), Tokenizer.from_file(PATH), encoder(PATH)
    letters = "ab'sélZ0 9 \n\t\r\x0b\x1c\x1f\x85\xa0  ​.,!%&中\U0001f600́"
    for n in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 25))) + ("<|endoftext|>" if n % 500 == 0 else "")
        assert np.frombuffer(enc.ids(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_round_robin_keeps_each_window_at_the_mix():
    held = np.array([10_000, 5_000, 0, 37, 1])
    served = packing.round_robin(held, np.array([3.0, -2.0, 0, 0, 0]), 100, 256)
    assert (served.sum(axis=0) == held).all() and served.min() >= 0
    assert served.sum(axis=1)[0] == 100 and set(served.sum(axis=1)[1:-1]) == {256}
    share = served[1:-1] / 256
    assert np.abs(share - held / held.sum()).max() < 2 / 256 + 1e-9


def check(spark, texts, pieces, ids=None, window=64):
    plain = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want[ids[i] if ids else i].append(np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    rows = pieces.collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x.doc_id].append(x)
        by_seq[x.sequence_id].append(x)
    assert set(by_doc) == set(want)
    for i, group in by_doc.items():
        if len(want[i]) == 1:
            at = 0
            for x in sorted(group, key=lambda x: x.start):
                assert x.start == at and x.doc_tokens == len(want[i][0])
                assert x.ids_crc32 == zlib.crc32(want[i][0][at:at + x.length].tobytes())
                at += x.length
            assert at == len(want[i][0])
        assert sum(x.length for x in group) == sum(map(len, want[i]))
    total = sum(len(a) for w in want.values() for a in w)
    assert sorted(by_seq) == list(range(-(-total // window)))
    for s, group in by_seq.items():
        at = 0
        for x in sorted(group, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at == min(window, total - s * window)


def test_every_id_lies_in_one_piece(spark):
    r = rng(4)
    texts = ["", None, "x" * 3000] + [prose(r, r.randint(0, 60)) for _ in range(60)] + ["same text"] * 5
    ids = [*range(63), None, 70, 70, 70, 71]
    sources = [None if i % 7 == 0 else f"s{i % 3}" for i in range(len(texts))]
    df = docs_frame(spark, texts, ids=ids, sources=sources)
    for lane in (10 ** 6, 400):   # one lane, and lanes that hand over inside windows
        check(spark, texts, packing.pack(df, tokenizer_path=PATH, window=64, lane_tokens=lane), ids)
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer_path=PATH).count() == 0
    mix = packing.sequences(packing.pack(df, tokenizer_path=PATH, window=64)).collect()
    assert all(sum(x.mix.values()) == x.length for x in mix)


def layout(pieces):
    return sorted((x.sequence_id, x.offset, x.doc_id or -1, x.start, x.length, x.ids_crc32) for x in pieces.collect())


def test_layout_does_not_hang_on_partitions(spark):
    r = rng(8)
    texts = [prose(r, r.randint(0, 60)) for _ in range(80)] + ["same text"] * 40
    ids = [*range(78), None, None, *[70] * 40]
    one = packing.pack(docs_frame(spark, texts, ids=ids, partitions=1), tokenizer_path=PATH, window=64, lane_tokens=700)
    five = packing.pack(docs_frame(spark, texts, ids=ids, partitions=5), tokenizer_path=PATH, window=64, lane_tokens=700)
    assert layout(one) == layout(five)
    check(spark, texts, one, ids)


def test_phases():
    got = packing.phases({"a": 600, "b": 100, "c": 0}, {"a": 2, "b": 1, "c": 5, "d": 0})
    assert [(p["low"], p["high"], p["tokens"]) for p in got] == [(0.0, 100.0, 300.0), (100.0, 300.0, 400.0)]
    assert got[0]["share"] == {"a": 2 / 3, "b": 1 / 3} and got[1]["share"] == {"a": 1.0}


def test_windows_keep_the_target_mix(spark):
    r = rng(2)
    texts = [prose(r, r.randint(10, 60)) for _ in range(900)]
    sources = ["a" if i % 2 else "b" if i % 3 else None if i % 7 == 0 else "c" for i in range(900)]
    df = docs_frame(spark, texts, sources=sources)
    weights = {"a": 1, "b": 2, "c": 1, "absent": 3}
    held = packing.tokenise(df, PATH, 1).groupBy("source").sum("n").collect()
    held = {x.source: x["sum(n)"] for x in held}
    steps = packing.phases({k: v for k, v in held.items() if k in weights}, weights)
    for lane in (10 ** 7, 6000):
        pieces = packing.pack(df, tokenizer_path=PATH, window=512, lane_tokens=lane, weights=weights)
        check(spark, texts, pieces, window=512)
        mix = {x.sequence_id: x for x in packing.sequences(pieces).collect()}
        at = 0
        for step in steps:
            inside = range(int((at + 3000) // 512) + 1, int((at + step["tokens"] - 3000) // 512))
            for w in inside if lane > 10 ** 6 else ():      # a lane of few documents holds no exact mix
                for s, share in step["share"].items():
                    assert abs(mix[w].mix.get(s, 0) / mix[w].length - share) < 0.1
            if len(inside) > 3:
                for s, share in step["share"].items():
                    assert abs(sum(mix[w].mix.get(s, 0) for w in inside) / (512 * len(inside)) - share) < 0.06
            at += step["tokens"]
        assert mix[len(mix) - 1].mix.keys() == {""}      # the source without a name comes last
