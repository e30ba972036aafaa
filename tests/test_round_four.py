"""Findings of round 4."""

import random


def _write(path, spark, rows, schema, name):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, path, texts):
    return _write(path, spark, [(i, t, "en", "web", len(t or "")) for i, t in texts], DOCS, "documents")


# ---- F11: embed_latent

def test_embed_latent_names_direction_and_part(spark, tmp_path):
    import numpy as np

    from tallyhawk.operators import latent
    from tallyhawk.plans.document_queries import q_embed_latent
    r = random.Random(4)
    topics = [["tax", "audit", "ledger", "fine"], ["truck", "road", "cargo", "port"], ["seed", "soil", "rain", "crop"]]
    sf = _docs(spark, tmp_path, [*((i, " ".join(r.choice(topics[0 if i < 25 else 1 + i % 2]) for _ in range(12))) for i in range(60)), (98, None)])
    got = {x.doc_id: x for x in q_embed_latent(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = latent.fit_latent(docs, "doc_id", dim=32)
    for x in model.embed(docs, "doc_id").collect():
        v = np.abs(np.array(x.embedding, dtype=float))
        row = got.pop(x.doc_id)
        if not v.any():
            assert row.direction is None and row.part == 0.0 and x.doc_id == 98
        else:
            assert abs(row.part - v.max() ** 2 / (v @ v)) < 2e-4 and v[row.direction] > v.max() - 1e-4 and row.dim == len(v)
    assert not got


# ---- F13, F7: similar_sentences

def _some_texts(seed, docs):
    r = random.Random(seed)
    words = ["invoice", "vendor", "audit", "payment", "approval", "manager", "mail", "review", "budget", "order"]
    return [(i, " ".join(" ".join(r.choice(words) for _ in range(r.randint(1, 5))).capitalize() + r.choice(".!?")
                         for _ in range(r.randint(0, 25)))) for i in range(docs)]


def _brute_pairs(w, threshold):
    import numpy as np
    vec, want = {}, {}
    for x in w.collect():
        v = vec.setdefault(x.doc_id, {}).setdefault(x.sent_id, {})
        v.setdefault(x.term, []).append(x.weight)
    for d, sents in vec.items():
        unit = {i: {t: sum(ws) / np.sqrt(sum(y * y for all_ in v.values() for y in all_)) for t, ws in v.items()} for i, v in sents.items()}
        for i in unit:
            for j in unit:
                cos = sum(x * unit[j].get(t, 0.0) for t, x in unit[i].items())
                if i < j and cos >= threshold - 1e-12:
                    want[d, i, j] = cos
    return want


def test_every_similar_pair_is_found_also_of_equal_sentences(spark, monkeypatch):
    from tallyhawk.operators import doctasks
    from tallyhawk.operators import textmine as T
    line = "Same line again here. "
    rows = [*_some_texts(9, 12), (50, line * 4 + "Same words here. Other thing. Same words here now. The of."), (51, None), (52, "One."), (None, line * 3)]
    sents = T.sentences(spark.createDataFrame(rows, "doc_id long, text string"))
    monkeypatch.setattr(doctasks, "PIECE", 7)
    monkeypatch.setattr(doctasks, "TILE", 4)
    for threshold in (0.35, 0.8):
        want = _brute_pairs(T.tfidf(sents), threshold)
        assert sum(d == 50 and abs(c - 1) < 1e-9 for (d, _, _), c in want.items()) == 6
        for most in (T.PAIR_CHARS, 150):        # all documents in one task, and the long ones by joins
            found = T.similar_pairs(sents, threshold, most).collect()
            got = {(x.doc_id, x.i, x.j): x.cosine for x in found}
            assert got.keys() == want.keys() and len(found) == len(got) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_similar_pairs_of_a_repeated_document(spark):
    from tallyhawk.operators import textmine as T
    rows = [(1, "Red fox runs. Red fox sleeps. A red sky, red sky."), (1, "Red fox runs. Blue. A red sky, red sky."), (2, "Red fox. Red fox.")]
    sents = T.sentences(spark.createDataFrame(rows, "doc_id long, text string"))
    found = T.similar_pairs(sents, 0.2).collect()
    want = _brute_pairs(T.tfidf(sents.where("doc_id = 2")), 0.2)
    assert {(x.doc_id, x.i, x.j) for x in found if x.doc_id == 2} == set(want) == {(2, 0, 1)}
    assert len({(x.doc_id, x.i, x.j) for x in found}) == len(found)


def test_terms_of_pairs_are_not_shuffled(spark):
    from tallyhawk.operators import textmine as T
    from test_scale import exchanges
    sents = T.sentences(spark.createDataFrame(_some_texts(3, 9), "doc_id long, text string").repartition(4, "doc_id"))
    assert exchanges(T.similar_pairs(sents, 0.6)) <= 1


# ---- F10, F9: doc_textrank, doc_ranked_sections

def test_ranks_of_documents_that_share_a_piece(spark, monkeypatch):
    from tallyhawk.operators import doctasks
    from tallyhawk.operators import textmine as T
    rows = [*_some_texts(3, 25), (99, "The of. A an. To be."), (100, ""), (101, None), (None, "No id. No rank?")]
    sents = T.sentences(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    want = {(x.doc_id, x.sent_id): x.score for x in T.textrank_joined(sents).collect()}
    for size in (1, 40, 10_000):
        monkeypatch.setattr(doctasks, "PIECE", size)
        plan = T.textrank(sents)
        assert "MapInArrow" in plan._jdf.queryExecution().toString()
        got = {(x.doc_id, x.sent_id): x.score for x in plan.collect()}
        assert abs(got.pop((None, 0)) - 0.075) < 1e-12 and abs(got.pop((None, 1)) - 0.075) < 1e-12
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    found = [t["doc_id"].to_pylist() for t in doctasks.pieces(_batches([[1, 1], [1, 2], [2, None], [None, 3]]), 2)]
    assert [x for t in found for x in t] == [1, 1, 1, 2, 2, None, None, 3] and all(not set(a) & set(b) for a, b in zip(found, found[1:]))


def test_sections_come_from_one_pass_over_the_ranked_sentences(spark):
    from test_scale import exchanges

    from tallyhawk.operators import textmine as T
    rows = [*_some_texts(5, 20), (70, "AUDIT RESULTS. All was paid in time. Vendors were paid. THE END PART. Much was late and vendors complained. Late."),
            (71, None), (72, "ONLY A HEADING."), (73, "No heading at all here in this one. And one more of the same.")]
    sents = T.sentences(spark.createDataFrame([(i, t and t.replace("Budget ", "BUDGET PLAN. Budget ")) for i, t in rows], "doc_id long, text string").repartition(4, "doc_id"))
    found = T.ranked_sections(sents)
    assert exchanges(found) <= 2
    got = sorted((x.doc_id, x.section_rank, x.section, x.sent_id, x.sentence) for x in found.collect())
    score = {(x.doc_id, x.sent_id): x.score for x in T.textrank(sents).collect()}
    heading = {(x.doc_id, x.sent_id): x.h for x in sents.select("*", T.is_heading(sents["sentence"]).alias("h")).collect()}
    want, parts = [], {}
    for x in sorted(sents.collect(), key=lambda x: (x.doc_id, x.sent_id)):
        doc = parts.setdefault(x.doc_id, [("Introduction", [])])
        doc.append((x.sentence, [])) if heading[x.doc_id, x.sent_id] else doc[-1][1].append((-score[x.doc_id, x.sent_id], x.sent_id, x.sentence))
    for d, secs in parts.items():
        for rank, (title, body) in enumerate([s for s in secs if s[1]][:T.SECTIONS_MAX], 1):
            want += [(d, rank, title, i, text) for _, i, text in sorted(body)[:2]]
    assert got == sorted(want) and any(x[2] != "Introduction" for x in got)


def _batches(ids):
    import pyarrow as pa
    for x in ids:
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(x, pa.int64())})


# ---- F12, F2: fraud_classifier

def _invoices(spark, n, vendors, seed=2, parts=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        v = r.randrange(vendors)
        fraud = int(v % 7 == 3 or r.random() < 0.05)
        rows.append((str(i), f"V{v:05}" if i % 50 else None, r.choice([None, 5.0, 7.5, 100.0]) if i % 9 == 0 else float(r.randint(1, 900) + 400 * fraud),
                     f"2025-0{r.randint(1, 9)}-1{r.randint(0, 9)}", fraud, f"N{i}", None))
    return spark.createDataFrame(rows, "InvoiceID string, Vendor string, Amount double, d string, IsFraudLabel int, InvoiceNumber string, PONumber string") \
        .selectExpr("*", "cast(d as timestamp_ntz) AS InvoiceDate").drop("d").repartition(parts)


def test_every_vendor_is_a_column_and_splits_are_the_best_of_the_drawn(spark, monkeypatch):
    import numpy as np

    from tallyhawk.operators import classifier as C
    monkeypatch.setattr(C, "TREES", 12)
    monkeypatch.setattr(C, "DEPTH", 3)
    forests = []
    for parts, piece in ((1, 1_000_000), (5, 40)):
        monkeypatch.setattr(C, "PIECE", piece)
        monkeypatch.setattr(C, "BLOCK", piece)
        model = C.train_classifier(_invoices(spark, 1600, 60, parts=parts))
        forests.append(model.forest)
        assert model.vendors.count() == 60
    a, b = forests          # whatever the partitions
    assert (a.feature == b.feature).all() and np.allclose(a.counts, b.counts) and np.allclose(a.value, b.value, equal_nan=True)
    feats = C._coded(C.classifier_features(_invoices(spark, 1600, 60)), model.vendors)
    cols = ["InvoiceID", "Vendor", "Amount", "IsFraudLabel", "InvoiceNumber", "PONumber", "InvoiceDate"]
    got = feats.selectExpr("_code", "_x0", "_x1", "_x2", "IsFraudLabel AS y", f"xxhash64({', '.join(f'string({c})' for c in cols)}) AS k").toPandas()
    salt = np.random.default_rng(C.SEED).integers(0, 1 << 63, C.TREES).astype(np.uint64)
    y, kinds = got["y"].to_numpy(), set()
    for t in range(C.TREES):
        z = (got["k"].to_numpy(np.int64).view(np.uint64) ^ salt[t]) * C._TIMES
        z = (z ^ (z >> np.uint64(32))) * C._AGAIN
        w = C._WEIGHTS[z >> np.uint64(48)].astype(float)
        members = {0: np.ones(len(y), bool)}
        for node in range(2 ** C.DEPTH - 1):
            if node not in members:
                continue
            m = members[node]

            def gini(of):
                n, ones = w[of].sum(), (w * y)[of].sum()
                return n - (ones ** 2 + (n - ones) ** 2) / n if n else 0.0
            best = 0.0
            for col in C._drawn(t, node, 3 + 60):
                x = got[f"_x{col}"].to_numpy() if col < 3 else None
                for v in (np.unique(x[~np.isnan(x)]) if col < 3 else [col - 3]):
                    left = m & ((x <= v) if col < 3 else (got["_code"].to_numpy() == v))
                    if w[left].sum() and w[m & ~left].sum():
                        best = max(best, (gini(m) - gini(left) - gini(m & ~left)) / w[m].sum())
            f, v = a.feature[t, node], a.value[t, node]
            if f < 0:
                assert best < 1e-9
                continue
            left = m & ((got[f"_x{f}"].to_numpy() <= v) if f < 3 else (got["_code"].to_numpy() == v))
            kinds.add(int(f))
            assert abs((gini(m) - gini(left) - gini(m & ~left)) / w[m].sum() - best) < 1e-9
            assert np.allclose(a.counts[t, node], [(w * (1 - y))[m].sum(), (w * y)[m].sum()])
            members[2 * node + 1], members[2 * node + 2] = left, m & ~left
    assert 3 in kinds and len(kinds) > 1


def test_more_vendors_than_slots_do_not_share_a_column(spark, monkeypatch):
    from tallyhawk.operators import classifier as C
    monkeypatch.setattr(C, "TREES", 5)
    df = _invoices(spark, 3000, 1500)
    model = C.train_classifier(df)
    n = df.where("Vendor is not null").select("Vendor").distinct().count()
    assert n > 1024 and sorted(x[0] for x in model.vendors.select("_known").collect()) == list(range(n))
    got = C.predict_fraud(model, df).collect()
    assert len(got) == 3000 and all(abs(sum(x.probability) - 1) < 1e-9 and x.prediction == float(x.fraud_probability > 0.5) for x in got)
    other = C.predict_fraud(model, df.where("InvoiceID % 2 = 0").withColumn("Vendor", df["Vendor"].substr(1, 3))).collect()
    assert len(other) == 1500 and all(0 <= x.fraud_probability <= 1 for x in other)


# ---- F14: op3_main_text

def test_host_repeats_are_those_of_a_whole_suffix_order(spark):
    from tallyhawk.llm.html_text import LEAST_KEPT, main_text
    r = random.Random(11)
    lines = [" ".join(r.choice("abcdef") for _ in range(r.randint(4, 14))) for _ in range(6)]
    pages = [[r.choice(lines) if r.random() < 0.4 else " ".join(r.choice("abcdefghij") for _ in range(r.randint(3, 12))) for _ in range(r.randint(2, 7))]
             for _ in range(14)]
    got = {x.page_id: x.text for x in main_text(spark.createDataFrame(
        [(i, f"http://h.org/{i}", "<body>" + "".join(f"<div>{b}</div>" for b in p) + "</body>") for i, p in enumerate(pages)],
        "page_id long, url string, html string")).collect()}
    streams = [" ".join(p).split() for p in pages]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n
    cut = 0
    for i, blocks in enumerate(pages):
        s, gone = streams[i], set()
        for k in range(len(s)):          # the length of the longest repeat from here that two more pages hold
            length = sorted((max(common(s[k:], o[j:]) for j in range(len(o))) for q, o in enumerate(streams) if q != i), reverse=True)[1]
            if length >= 6:
                gone |= set(range(k, k + length))
        at, kept = 0, []
        for b in blocks:
            n = len(b.split())
            if not set(range(at, at + n)) <= gone:
                kept.append(b)
            at += n
        if len(" ".join(kept).split()) < LEAST_KEPT * len(s):
            kept = blocks
        cut += len(blocks) - len(kept)
        assert got[i] == " ".join(kept)
    assert cut > 5
