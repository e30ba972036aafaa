"""Second computations of features, and odd inputs: repeated rows, null ids, clashing columns, very long texts, empty tables."""

import math
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from helpers import DOCS, components, docs_frame, prose, rng, words
from pyspark.sql import functions as F

from tallyhawk.llm import embedding_dedup, mixing, near_dedup, packing, quality, substring_dedup, toxicity

CLASH = ["id", "v", "dim", "digest", "sig", "key", "centre", "component", "source_size", "lane", "nth", "n", "ids", "copies", "block", "shard",
         "no_id", "words", "batch", "logp", "kept", "n_words"]


def clashing(df):
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASH if c not in df.columns})


# ---- toxicity, computed again

def slow_features(text, lexicon):
    text = text or ""
    kinds = Counter()
    for b in text.encode():
        c = chr(b)
        kinds["capital"] += "A" <= c <= "Z"
        kinds["digit"] += "0" <= c <= "9"
        kinds["bang"] += c == "!"
        kinds["point"] += c in ".,;:?'\"()-"
        kinds["symbol"] += 0x21 <= b < 0x7F and not c.isalnum() and c not in "!.,;:?'\"()-"
    chars, ws = max(1, len(text)), text.lower().split()
    n = max(1, len(ws))
    clean = [re.sub(r"^\W+|\W+$", "", w) for w in ws]
    plain = " ".join(clean).translate(str.maketrans("0134578@$", "oieastbas"))
    hits = {}
    at = 0
    for i, w in enumerate(clean):
        found = [(odds, t) for t, odds in lexicon.items() if plain.startswith(t, at)]
        if found:
            hits[i] = max(odds for odds, _ in found), [t for odds, t in found if odds == max(found)[0]]
        at += len(w) + 1
    you = [i for i, w in enumerate(clean) if w in toxicity.SECOND_PERSON]
    near = sum(any(abs(i - k) <= toxicity.NEAR_WORDS for k in you) for i in hits)
    run = best = 1
    for a, b in zip(ws, ws[1:]):
        run = run + 1 if a == b else 1
        best = max(best, run)
    odds = [o for o, _ in hits.values()]
    caps = sum(w.isupper() for w in re.findall(r"\b[^\W\d_]{2,}\b", text))
    return {"log_words": math.log1p(len(ws)), "hits": len(hits), "density": len(hits) / n, "weight_density": sum(odds) / n,
            "max_weight": max(odds, default=0), "near_rate": near / n, "near_hits": near, "second_person": len(you) / n,
            "capitals": kinds["capital"] / chars, "caps_words": caps / n, "punctuation": (kinds["bang"] + kinds["point"]) / chars,
            "exclamations": kinds["bang"] / n, "digits": kinds["digit"] / chars, "symbols": kinds["symbol"] / chars,
            "word_length": chars / n, "distinct_words": len(set(ws)) / n, "longest_run": best / n}


def test_features_equal_a_slow_computation():
    r = rng(31)
    lexicon = {"moron": 3.0, "scum": 2.6, "idio": 4.0, "idiot": 3.5, "trash": 2.7}
    pieces = ["you", "Your,", "m0ron!!", "SCUM", "idiotic", "id1ot", "tr@sh", "fine", "word", "Word", "...", "50%", "(ok)", "é!", "tu", "a"]
    for _ in range(300):
        text = " ".join(r.choice(pieces) for _ in range(r.randint(0, 40)))
        got = dict(zip(toxicity.FEATURES, toxicity.text_features(text, toxicity._automaton(lexicon))))
        for name, value in slow_features(text, lexicon).items():
            assert math.isclose(got[name], value, rel_tol=1e-9, abs_tol=1e-12), (name, text)


def test_lexicon_equals_a_slow_computation(spark):
    r = rng(32)
    rows = []
    for i in range(120):
        bad = i % 3 == 0
        rows.append((prose(r, 12, 30) + (" " + r.choice(["Moron,", "scum!"]) if bad and r.random() < 0.8 else ""), int(bad)))
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    inside, every = Counter(), Counter()
    for text, label in rows:
        ws = {re.sub(r"^[\W\d_]+|[\W\d_]+$", "", w) for w in text.lower().split()} - {""}
        every.update(ws)
        inside.update(ws if label else ())
    ones = sum(b for _, b in rows)
    odds = {w: math.log((inside[w] + .5) / (ones + 1)) - math.log((every[w] - inside[w] + .5) / (len(rows) - ones + 1)) for w in every
            if inside[w] >= toxicity.MIN_DOCS}
    want = {w: o for w, o in odds.items() if o >= toxicity.MIN_LOG_ODDS}
    assert got.keys() == want.keys() and want and all(math.isclose(got[w], want[w]) for w in want)


# ---- embeddings

def test_embeddings_of_any_scale_repeated_rows_and_null_ids(spark):
    rows = [(1, [1e-200, 0.0], 1), (2, [2e-200, 1e-210], 1), (3, [1e200, 1e200], 1), (4, [3e200, 3e200], 1), (5, [0.0, 0.0], 1),
            (6, [1e-200, 0.0], None), (None, [1e200, 1e200], 1), (4, [3e200, 3e200], 1)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"))
    got = sorted((x.vec_id or 0, x.n_links, x.component_id, x.kept) for x in embedding_dedup.embedding_groups(df).collect()
                 if x.vec_id is not None)
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True)]
    none = [x for x in embedding_dedup.embedding_groups(df).collect() if x.vec_id is None]
    assert len(none) == 1 and none[0].n_links == 0


# ---- the same rows with columns of other names in the way

def test_clashing_columns_change_nothing(spark):
    r = rng(17)
    texts = [prose(r, r.randint(3, 40), 60) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", None, "", "a b " * 30_000]
    docs = docs_frame(spark, texts)
    wide = clashing(docs)
    trusted = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    path = public_tokenizers.path("byte_bpe_50k.json")
    runs = {
        "near": lambda d: near_dedup.near_groups(d, words=2),
        "passages": lambda d: substring_dedup.drop_repeated_passages(d).select("doc_id", "n_words", "n_removed", "kept_text"),
        "mix": lambda d: mixing.mix(d).select("doc_id", "taken"),
        "pack": lambda d: packing.pack(d, tokenizer_path=path, window=64),
        "quality": lambda d: quality.quality(d, trusted).select("doc_id", "n_chars", F.round("perplexity", 9).alias("p"), "kept")}
    for name, run in runs.items():
        row = lambda x: tuple((v is not None, v) if v is not None else (False, 0) for v in x)
        assert sorted(map(row, run(wide).collect())) == sorted(map(row, run(docs).collect())), name


def test_a_very_long_text_and_its_copy_in_part(spark):
    r = rng(19)
    long = [f"w{r.randint(0, 10 ** 6)}" for _ in range(120_000)]
    part = long[50_000:50_040]
    docs = docs_frame(spark, [" ".join(long), "begin " + " ".join(part) + " end", "short"], ids=[5, 7, 8])
    got = {x.doc_id: x for x in substring_dedup.drop_repeated_passages(docs).collect()}
    assert got[5].n_removed == 0 and got[5].n_words == 120_000
    assert got[7].kept_text == "begin end" and got[7].n_removed == 40 and got[8].n_removed == 0


# ---- the pipeline on odd documents

def _run(spark, tmp_path, rows):
    folder = str(tmp_path / "tables")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, folder).collect()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert _run(spark, tmp_path, []) == []


def test_pipeline_with_nulls_repeats_and_long_texts(spark, tmp_path):
    r = rng(23)
    texts = [prose(r, 30, 5000) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows += [(7, texts[7], "en", "s1", 0), (90, texts[3].upper(), None, None, None), (None, "a text without an id " * 3, "en", "s0", 1),
             (91, None, "en", "s0", 0), (92, "", "en", "s1", 0), (93, prose(r, 30_000, 10 ** 6), "en", "s0", 0)]
    pieces = _run(spark, tmp_path, rows)
    ids = {x.doc_id for x in pieces}
    assert 3 not in ids and ids <= {*range(30), 90, 93, None} - {3} and {90, 93} <= ids    # the copy with the larger id stays
    at = {}
    for x in sorted(pieces, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == at.get(x.sequence_id, 0)
        at[x.sequence_id] = x.offset + x.length
    assert all(n == packing.WINDOW for s, n in at.items() if s < max(at))


def test_components_helper_matches_itself():
    assert components([1, 2, 3], [(2, 3)]) == {1: 1, 2: 2, 3: 2} and words(" a\tb") == ["a", "b"] and np.isfinite(1.0)
