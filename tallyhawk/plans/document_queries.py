"""Registered queries over documents, embeddings and invoice vectors (I, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhawk.functions import vocab
from tallyhawk.operators import documents as D
from tallyhawk.operators import textmine as T
from tallyhawk.operators import vectors as V
from tallyhawk.plans.oracle_sql import on_scored
from tallyhawk.plans.registry import register
from tallyhawk.sources.fixtures import spread, table


def _docs(spark, sf):
    return spread(table(spark, sf, "documents"), "doc_id")


def _blocks(spark, sf):
    docs = _docs(spark, sf)
    return D.document_blocks(docs.withColumn("text", D.clean_text(F.col("text"))))


def _lit_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + "]"


# DuckDB text helpers (RE2: \s is ASCII; the test documents hold no other whitespace)
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.replace("{x}", x)


def clean_sql(x: str) -> str:
    t = f"replace({x}, chr(160), ' ')"
    t = f"replace({t}, chr(13), chr(10))"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    return strip(t)


def flat_sql(x: str) -> str:
    return strip(f"replace(replace({x}, chr(13), ' '), chr(10), ' ')")


def sentences_sql(x: str) -> str:
    """I12 splitter without look-behind: mark the boundary, then split on the mark."""
    marked = f"regexp_replace({flat_sql(x)}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), "
            f"lambda s: length(s) > 0)")


def words_sql(x: str) -> str:
    f = flat_sql(x)
    return f"CASE WHEN length({f}) = 0 THEN 0 ELSE len(regexp_split_to_array({f}, '\\s+')) END"


def tokens_sql(x: str) -> str:
    t = strip(f"regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g')")
    return (f"list_filter(regexp_split_to_array({t}, '\\s+'), "
            f"lambda w: length(w) > 1 AND NOT list_contains({_lit_list(vocab.SUMMARY_STOP_WORDS)}, w))")


SENTS_CTE = f"""sents AS (
  SELECT doc_id, CAST(i - 1 AS INT) AS sent_id, s[i] AS sentence
  FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM documents) x,
       LATERAL generate_series(1, len(s)) g(i))"""

TERMS_CTE = f"""{SENTS_CTE},
toks AS (SELECT doc_id, sent_id, {tokens_sql('sentence')} AS t FROM sents),
terms AS (
  SELECT doc_id, sent_id, term, len(t) AS len, count(*) AS tf
  FROM (SELECT doc_id, sent_id, t, unnest(t) AS term FROM toks WHERE len(t) > 0)
  GROUP BY doc_id, sent_id, term, len(t)),
nsent AS (SELECT doc_id, count(*) AS n_sent FROM sents GROUP BY doc_id),
dfreq AS (SELECT doc_id, term, count(*) AS df FROM terms GROUP BY doc_id, term),
w AS (
  SELECT t.*, ln((n_sent + 1) / (df + 1)) + 1.0 AS idf, tf / len * (ln((n_sent + 1) / (df + 1)) + 1.0) AS weight
  FROM terms t JOIN dfreq USING (doc_id, term) JOIN nsent USING (doc_id)),
norms AS (SELECT doc_id, sent_id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY doc_id, sent_id),
u AS (SELECT doc_id, sent_id, term, weight / norm AS u FROM w JOIN norms USING (doc_id, sent_id))"""


# ---- I1–I5 -----------------------------------------------------------------------------------

@register("doc_clean", f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")
def q_doc_clean(spark, sf):
    return _docs(spark, sf).select("doc_id", D.clean_text(F.col("text")).alias("text"))


@register("doc_blocks", f"""
SELECT doc_id, source AS file_name, 'Page ' || CAST(i AS VARCHAR) AS location, 'txt' AS doc_type, b AS block_text
FROM (SELECT doc_id, source, p, i, {clean_sql('p[i]')} AS b
      FROM (SELECT doc_id, source, string_split(text, chr(12)) AS p FROM documents) x,
           LATERAL generate_series(1, len(p)) g(i))
WHERE length(b) > 0""")
def q_doc_blocks(spark, sf):
    docs = _docs(spark, sf).select("doc_id", F.col("source").alias("file_name"), "text")
    return D.page_blocks(docs).select("doc_id", "file_name", "location", F.lit("txt").alias("doc_type"),
                                      "block_text")


@register("doc_sections")
def q_doc_sections(spark, sf):
    return D.section_blocks(_docs(spark, sf)).select("doc_id", "location", F.length("block_text").alias("chars"))


CHUNKS_CTE = f"""ct AS (SELECT doc_id, source AS file_name, {strip(clean_sql('text'))} AS t FROM documents),
raw_chunks AS (
  SELECT doc_id, file_name, s, {strip('substring(t, CAST(s * 580 + 1 AS BIGINT), 700)')} AS piece
  FROM ct, LATERAL generate_series(0, CAST(greatest(0, ceil((length(t) - 700) / 580.0)) AS BIGINT)) g(s)
  WHERE length(t) > 700
  UNION ALL
  SELECT doc_id, file_name, 0, t FROM ct WHERE length(t) BETWEEN 1 AND 700),
chunks AS (
  SELECT doc_id, file_name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) AS INT) AS chunk_id,
         piece AS chunk_text
  FROM raw_chunks WHERE length(piece) > 0)"""


def _chunks(spark, sf):
    return D.build_chunks(_blocks(spark, sf))


@register("doc_chunks", f"WITH {CHUNKS_CTE} SELECT doc_id, file_name, chunk_id, chunk_text FROM chunks")
def q_doc_chunks(spark, sf):
    return _chunks(spark, sf).select("doc_id", "file_name", "chunk_id", "chunk_text")


@register("doc_index_summary", f"""WITH {CHUNKS_CTE},
pf AS (SELECT file_name, count(*) AS file_chunks FROM chunks GROUP BY file_name)
SELECT file_name, file_chunks, count(*) OVER () AS total_files, sum(file_chunks) OVER () AS total_chunks
FROM pf""")
def q_doc_index_summary(spark, sf):
    return D.index_summary(_chunks(spark, sf)).select("file_name", "file_chunks", "total_files",
                                                     F.col("total_chunks").cast("long").alias("total_chunks"))


@register("doc_fallback", f"""
SELECT doc_id, CASE WHEN length(t) <= 220 THEN t
  ELSE (CASE WHEN contains(substring(t, 1, 220), ' ')
             THEN regexp_replace(substring(t, 1, 220), ' [^ ]*$', '') ELSE substring(t, 1, 220) END) || '...' END
  AS fallback
FROM (SELECT doc_id, {strip("regexp_replace(replace(text, chr(10), ' '), '\\s+', ' ', 'g')")} AS t FROM documents)""")
def q_doc_fallback(spark, sf):
    return _docs(spark, sf).select("doc_id", D.fallback_answer(F.col("text")).alias("fallback"))


# fixed question prompts, one per answer family
ANSWER_PROMPTS = [
    "what is the tax procedure", "which pricing procedure is used", "what is the approval threshold",
    "which vendor account groups exist", "what does the tolerance key allow", "what payment terms apply",
    "how is inventory posting configured", "when does three-way match apply",
    "what was the duplicate invoice lesson",
]


@register("doc_direct_answer")
def q_doc_direct_answer(spark, sf):
    """I8 on every chunk (answers are read from search hits, which are chunks of at
    most 700 characters) for each of nine fixed prompts."""
    from tallyhawk.session import materialize
    chunks = materialize(_chunks(spark, sf).select("doc_id", "chunk_id", D.collapse_ws(F.col("chunk_text")).alias("text")),
                         "chunks-collapsed")
    # a prompt is a constant: the optimizer keeps only its own family of patterns
    answers = F.array(*[F.struct(F.lit(i).alias("prompt_id"), D.direct_answer(F.lit(p), F.col("text"), True).alias("answer"))
                        for i, p in enumerate(ANSWER_PROMPTS)])
    return chunks.select("doc_id", "chunk_id", F.explode(answers).alias("a")) \
        .select("doc_id", "chunk_id", "a.prompt_id", "a.answer").where("answer is not null")


def _question_log(spark, sf):
    """User turns, numbered: a number cannot stand for two questions."""
    from tallyhawk.operators.ordinal import with_ordinal
    conv = table(spark, sf, "conversations").where(F.col("role") == "user")
    return with_ordinal(conv.select("conv_id", "turn", F.col("text").alias("query")), ["conv_id", "turn", "query"], "query_id")


@register("doc_answer")
def q_doc_answer(spark, sf):
    """Questions (user turns) → embedded in the chunk space → top 8 chunks →
    threshold, repeat removal, rank ≤ 5 → answer with source line."""
    from tallyhawk.operators.search import answer_questions
    from tallyhawk.session import materialize
    asked = materialize(_question_log(spark, sf), "question-log")
    found = answer_questions(_chunks(spark, sf), asked.select("query_id", "query"))
    return asked.select("conv_id", "turn", "query_id").join(found, "query_id").drop("query_id")


# ---- I12–I27 --------------------------------------------------------------------------------

@register("doc_lead_summary", f"""
SELECT doc_id, {words_sql('text')} AS word_count,
       array_to_string(s[1:3], chr(10)) AS key_points, len(s[1:3]) AS n_points
FROM (SELECT doc_id, text, {sentences_sql('text')} AS s FROM documents)""")
def q_doc_lead_summary(spark, sf):
    s = T.lead_summary(_docs(spark, sf))
    return s.select("doc_id", "word_count", F.array_join("key_points", "\n").alias("key_points"),
                    F.size("key_points").alias("n_points"))


@register("doc_combined_summary", f"""WITH {SENTS_CTE},
top AS (SELECT * FROM sents ORDER BY doc_id, sent_id LIMIT 10)
SELECT string_agg(sentence, ' ' ORDER BY doc_id, sent_id) AS summary, count(*) AS sentences_in_summary FROM top""")
def q_doc_combined_summary(spark, sf):
    return T.combined_summary(_docs(spark, sf), 10)


@register("doc_stats", f"""
SELECT count(*) AS total_documents, coalesce(sum(w), 0) AS total_words,
       coalesce(sum(s), 0) AS total_sentences_analysed, least(coalesce(sum(s), 0), 10) AS sentences_in_summary
FROM (SELECT {words_sql('text')} AS w, len({sentences_sql('text')}) AS s FROM documents)""")
def q_doc_stats(spark, sf):
    return T.summary_stats(_docs(spark, sf), 10).select(
        "total_documents", F.col("total_words").cast("long").alias("total_words"),
        F.col("total_sentences_analysed").cast("long").alias("total_sentences_analysed"),
        F.col("sentences_in_summary").cast("long").alias("sentences_in_summary"))


@register("doc_tokens", f"""
SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)""")
def q_doc_tokens(spark, sf):
    t = _docs(spark, sf).select("doc_id", T.token_array(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@register("doc_tfidf", f"""WITH {TERMS_CTE}
SELECT doc_id, sent_id, term, tf, round(weight, 12) AS weight FROM w""")
def q_doc_tfidf(spark, sf):
    w = T.tfidf(T.sentences(_docs(spark, sf)))
    return w.select("doc_id", "sent_id", "term", "tf", F.round("weight", 12).alias("weight"))


@register("sentence_similarity", f"""WITH {TERMS_CTE},
s AS (SELECT doc_id, term, sum(u) AS S FROM u GROUP BY doc_id, term),
mass AS (SELECT doc_id, sent_id, sum(u.u * (s.S - u.u)) AS mass FROM u JOIN s USING (doc_id, term)
         GROUP BY doc_id, sent_id),
nxt AS (SELECT a.doc_id, a.sent_id, sum(a.u * b.u) AS next_sim
        FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.sent_id = a.sent_id + 1 AND a.term = b.term
        GROUP BY a.doc_id, a.sent_id)
SELECT doc_id, sent_id, round(mass, 9) AS mass, round(coalesce(next_sim, 0.0), 9) AS next_sim
FROM mass LEFT JOIN nxt USING (doc_id, sent_id)""")
def q_sentence_similarity(spark, sf):
    w = T.tfidf(T.sentences(_docs(spark, sf)))
    return T.sentence_similarity(w).select("doc_id", "sent_id", F.round("mass", 9).alias("mass"),
                                            F.round(F.coalesce("next_sim", F.lit(0.0)), 9).alias("next_sim"))


@register("doc_textrank")
def q_doc_textrank(spark, sf):
    return T.textrank(T.sentences(_docs(spark, sf)))


@register("doc_textrank_joined")
def q_doc_textrank_joined(spark, sf):
    """I17 by rounds of joins over all documents."""
    return T.textrank_joined(T.sentences(_docs(spark, sf))).withColumn("score", F.round("score", 6))


@register("doc_ranked_sections")
def q_doc_ranked_sections(spark, sf):
    """I22 with the scores of I17."""
    return T.ranked_sections(T.sentences(_docs(spark, sf)))


@register("similar_sentences", f"""WITH {TERMS_CTE},
f AS (SELECT doc_id, sent_id, term, u AS x FROM u)
SELECT a.doc_id, a.sent_id AS i, b.sent_id AS j, round(sum(a.x * b.x), 5) AS cosine
FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.term = b.term AND a.sent_id < b.sent_id
GROUP BY a.doc_id, a.sent_id, b.sent_id HAVING sum(a.x * b.x) >= 0.617""")
def q_similar_sentences(spark, sf):
    """I16: all sentence pairs of a document with a cosine of at least 0.617, equal sentences among them."""
    return T.similar_pairs(T.sentences(_docs(spark, sf)), 0.617).withColumn("cosine", F.round("cosine", 5))


@register("doc_keywords", f"""WITH {TERMS_CTE},
idf AS (SELECT DISTINCT doc_id, term, idf FROM w),
tok AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
tot AS (SELECT doc_id, sum(tf) AS total FROM tf GROUP BY doc_id),
sc AS (SELECT doc_id, term, tf / total * coalesce(idf, 1.0) AS score
       FROM tf JOIN tot USING (doc_id) LEFT JOIN idf USING (doc_id, term)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM sc)
SELECT doc_id, rank, term, round(score, 12) AS score FROM r WHERE rank <= 15""")
def q_doc_keywords(spark, sf):
    docs = _docs(spark, sf)
    k = T.keywords(docs, T.sentences(docs))
    return k.select("doc_id", F.col("rank").cast("long").alias("rank"), "term", F.round("score", 12).alias("score"))


@register("doc_phrases")
def q_doc_phrases(spark, sf):
    return T.key_phrases(_docs(spark, sf))


ENTITY_PATTERNS = {"currency_figures": vocab.CURRENCY_PATTERN, "percentages": vocab.PERCENT_PATTERN,
                   "dates": vocab.DATE_PATTERN, "sap_codes": vocab.CODE_PATTERN, "organisations": vocab.ORG_PATTERN}


def _entities_sql() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, regexp_extract_all(text, '{rx}') AS l FROM documents"
        for kind, rx in ENTITY_PATTERNS.items())
    cols = ", ".join(f"coalesce(string_agg(m, ' | ' ORDER BY p) FILTER (WHERE kind = '{kind}'), '') AS {kind}"
                     for kind in ENTITY_PATTERNS)
    return f"""
WITH f AS ({found}),
x AS (SELECT doc_id, kind, unnest(l) AS m, generate_subscripts(l, 1) AS i FROM f),
d AS (SELECT doc_id, kind, m, min(i) AS p FROM x GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY p) AS r FROM d) WHERE r <= 8),
g AS (SELECT doc_id, {cols} FROM t GROUP BY doc_id)
SELECT documents.doc_id, {", ".join(f"coalesce({kind}, '') AS {kind}" for kind in ENTITY_PATTERNS)}
FROM documents LEFT JOIN g USING (doc_id)"""


@register("doc_entities", _entities_sql())
def q_doc_entities(spark, sf):
    e = T.entities(_docs(spark, sf))
    return e.select("doc_id", *[F.array_join(f"entities.{k}", " | ").alias(k) for k in ENTITY_PATTERNS])


HEADING_SQL = """(length({s}) <= 120 AND (
   ({s} = upper({s}) AND {s} <> lower({s}) AND length({s}) > 3)
   OR regexp_matches({s}, '^\\d+[\\.\\)]\\s+[A-Z]')
   OR regexp_matches({s}, '^[A-Z][^.!?]{3,60}$')))"""


def heading_sql(x: str) -> str:
    return HEADING_SQL.replace("{s}", strip(x))


@register("doc_headings", f"""WITH {SENTS_CTE}
SELECT doc_id, sent_id, {heading_sql('sentence')} AS is_heading FROM sents""")
def q_doc_headings(spark, sf):
    s = T.sentences(_docs(spark, sf))
    return s.select("doc_id", "sent_id", T.is_heading(F.col("sentence")).alias("is_heading"))


@register("doc_section_summary", f"""WITH {SENTS_CTE},
h AS (SELECT *, {heading_sql('sentence')} AS hd FROM sents),
sec AS (SELECT *, sum(CAST(hd AS INT)) OVER (PARTITION BY doc_id ORDER BY sent_id) AS sn FROM h),
titles AS (SELECT doc_id, sn, {strip('sentence')} AS section FROM sec WHERE hd),
body AS (SELECT b.*, coalesce(t.section, 'Introduction') AS section FROM sec b LEFT JOIN titles t USING (doc_id, sn)
         WHERE NOT b.hd),
sr AS (SELECT doc_id, sn, row_number() OVER (PARTITION BY doc_id ORDER BY sn) AS section_rank
       FROM (SELECT DISTINCT doc_id, sn FROM body)),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sn ORDER BY length(sentence) DESC, sent_id) AS r FROM body)
SELECT doc_id, section_rank, section, sent_id, sentence FROM top JOIN sr USING (doc_id, sn)
WHERE r <= 2 AND section_rank <= 12""")
def q_doc_section_summary(spark, sf):
    s = T.sentences(_docs(spark, sf)).withColumn("score", F.length("sentence"))
    return T.sections(s).select("doc_id", F.col("section_rank").cast("long").alias("section_rank"), "section",
                                "sent_id", "sentence")


def _doc_type_sql() -> str:
    parts = []
    for label, words in vocab.DOC_TYPES:
        cond = " OR ".join(f"contains(lower(text), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + f" ELSE '{vocab.DOC_TYPE_DEFAULT}' END"


@register("doc_type", f"SELECT doc_id, {_doc_type_sql()} AS doc_type FROM documents")
def q_doc_type(spark, sf):
    return _docs(spark, sf).select("doc_id", T.doc_type(F.col("text")).alias("doc_type"))


@register("doc_tone", f"""
SELECT doc_id, CASE WHEN neg > pos + 1 THEN '{vocab.TONE_RISK}' WHEN pos > neg + 1 THEN '{vocab.TONE_POSITIVE}'
                    ELSE '{vocab.TONE_NEUTRAL}' END AS tone
FROM (SELECT doc_id,
        len(list_intersect(list_distinct(t), {_lit_list(vocab.POSITIVE_WORDS)})) AS pos,
        len(list_intersect(list_distinct(t), {_lit_list(vocab.NEGATIVE_WORDS)})) AS neg
      FROM (SELECT doc_id, regexp_split_to_array({strip('lower(text)')}, '\\s+') AS t FROM documents))""")
def q_doc_tone(spark, sf):
    return _docs(spark, sf).select("doc_id", T.tone(F.col("text")).alias("tone"))


@register("doc_reading_time", f"""
SELECT doc_id, w AS word_count, CAST(greatest(1, CAST(round_even(w / 200.0, 0) AS INT)) AS VARCHAR) || ' min read'
  AS reading_time
FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)""")
def q_doc_reading_time(spark, sf):
    d = _docs(spark, sf).select("doc_id", T.word_count(F.col("text")).alias("word_count"))
    return d.select("doc_id", "word_count", T.reading_time(F.col("word_count")).alias("reading_time"))


def _long_sentences_sql() -> str:
    """Mark each split point (both alternatives of the pattern), split at the marks, strip, filter."""
    marked = "regexp_replace(text, '([.!?])\\s+([A-Z\"''])', '\\1' || chr(1) || '\\2', 'g')"
    marked = f"regexp_replace({marked}, '\\n\\s*([A-Z\"''])', chr(1) || '\\1', 'g')"
    return f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}),
             lambda s: len(regexp_split_to_array(s, '\\s+')) >= 5) AS l FROM documents)
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS sent_id, unnest(l) AS sentence FROM s"""


@register("doc_long_sentences", _long_sentences_sql())
def q_doc_long_sentences(spark, sf):
    return T.long_sentences(_docs(spark, sf))


# ---- K / I7: vectors ------------------------------------------------------------------------

CENTROIDS_SQL = """cen AS (
  SELECT label AS query_id, list(m ORDER BY i) AS qv FROM (
    SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m
    FROM embeddings, LATERAL generate_series(1, len(embedding)) g(i) GROUP BY label, i) GROUP BY label),
sims AS (
  SELECT c.query_id, e.vec_id AS match_id, e.label,
         list_dot_product(c.qv, CAST(e.embedding AS DOUBLE[])) /
         CASE WHEN sqrt(list_dot_product(c.qv, c.qv)) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) = 0
              THEN 1e-10
              ELSE sqrt(list_dot_product(c.qv, c.qv)) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) END AS score
  FROM cen c, embeddings e)"""


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


@register("cosine_topk", f"""WITH {CENTROIDS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS rank FROM sims)
SELECT query_id, CAST(rank AS INT) AS rank, match_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def q_cosine_topk(spark, sf):
    e = _emb(spark, sf)
    hits = V.cosine_topk(V.label_centroids(e), e, k=5)
    return hits.withColumn("score", F.round("score", 6))


@register("cosine_neighbours", f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sims AS (SELECT a.vec_id AS query_id, b.vec_id AS match_id, list_cosine_similarity(a.e, b.e) AS score FROM v a, v b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS rank FROM sims WHERE match_id <> query_id)
SELECT query_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def q_cosine_neighbours(spark, sf):
    """Queries are all rows whose id is divisible by 100, against all rows; the row itself is left out.

    Copies of one vector tie, and their order hangs on the last bit of a score: ranks and scores are compared."""
    from pyspark.sql import Window
    e = _emb(spark, sf)
    hits = V.cosine_topk(_row_queries(e), e, k=6).where("match_id <> query_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return hits.select("query_id", "rank", F.round("score", 6).alias("score"))


def _row_queries(e):
    return e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@register("cells_topk")
def q_cells_topk(spark, sf):
    """K8 through an inverted-file index of all rows; queries are all rows whose id is divisible by 100."""
    import uuid

    from tallyhawk.operators.cells import build_cells, search_cells
    from tallyhawk.session import scratch_path
    e = _emb(spark, sf)
    path = scratch_path(spark, f"cells-{uuid.uuid4().hex}")
    build_cells(e, path)
    return search_cells(spark, path, _row_queries(e), k=5)


@register("vendor_similar", f"""WITH {CENTROIDS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS rank
      FROM sims WHERE label = query_id)
SELECT query_id, CAST(rank AS INT) AS rank, match_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def q_vendor_similar(spark, sf):
    e = _emb(spark, sf)
    q = V.label_centroids(e).withColumn("label", F.col("query_id"))
    hits = V.vendor_topk(q, e, k=5, group="label")
    return hits.withColumn("score", F.round("score", 6))


@register("doc_search", f"""WITH {CENTROIDS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS rank FROM sims),
kept AS (SELECT * FROM r WHERE rank <= 8 AND score >= 0.20),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank2 FROM kept)
SELECT query_id, CAST(rank2 AS INT) AS rank, match_id, round(score, 6) AS score FROM r2 WHERE rank2 <= 5""")
def q_doc_search(spark, sf):
    """I7 on the embeddings table: top 8, drop < 0.20, drop repeated keys, report 5."""
    from tallyhawk.operators.search import report_hits
    e = _emb(spark, sf)
    hits = V.cosine_topk(V.label_centroids(e), e, k=D.SEARCH_K)
    keyed = hits.select("*", F.col("match_id").alias("key"))
    return report_hits(keyed, ["key"]).drop("key").withColumn("score", F.round("score", 6))


@register("embed_text")
def q_embed_text(spark, sf):
    ch = _chunks(spark, sf).select("doc_id", "chunk_id", F.col("chunk_text").alias("text"))
    e = V.embed_text(ch)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    filled = F.size(F.filter("embedding", lambda x: x != 0))
    shown = lambda x: F.when(x == 0, "0.0000").otherwise(F.format_string("%.4f", x.cast("double")))
    digest = F.md5(F.array_join(F.transform("embedding", shown), ","))
    return e.select("doc_id", "chunk_id", F.size("embedding").alias("dim"), filled.alias("non_zero"),
                    F.round(F.sqrt(square), 4).alias("norm"), digest.alias("digest"))


@register("embed_latent")
def q_embed_latent(spark, sf):
    """K2 with term vectors trained on all documents: each document's nearest direction (from 0, by singular value) and
    its part in it, the direction's share of the squared vector. A document without terms has neither: null and 0."""
    from tallyhawk.operators.latent import fit_latent
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = fit_latent(docs, "doc_id", dim=32)
    e = V.embed_text(docs, model=model, key="doc_id")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    # an axis has no sign of its own: the nearest one has the greatest component either way, ties go to the first
    size = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    nearest = F.array_position(size, F.array_max(size)).cast("int") - 1
    part = F.when(norm > 0, F.array_max(size) * F.array_max(size) / (norm * norm)).otherwise(F.lit(0.0))
    return e.select("doc_id", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"),
                    F.when(norm > 0, nearest).alias("direction"), F.round(part, 4).alias("part"))


@register("cosine_lsh")
def q_cosine_lsh(spark, sf):
    e = _emb(spark, sf)
    return V.cosine_lsh(V.label_centroids(e), e, k=5)


@register("invoice_text", on_scored("""
SELECT InvoiceID, 'Invoice ' || coalesce(InvoiceNumber, 'None') || ' (ID ' || InvoiceID || ') from vendor '
  || coalesce(Vendor, 'None') || ' on ' || coalesce(strftime(InvoiceDate, '%Y-%m-%d'), 'unknown date')
  || ' for amount ' || printf('%.2f', Amount) || ' ' || coalesce(Currency, 'None') || ' with PO '
  || coalesce(PONumber, 'None') || '. Risk level: ' || RiskLevel || '. Reason: ' || RiskReason || '.' AS text
FROM scored"""))
def q_invoice_text(spark, sf):
    from tallyhawk.plans.invoice_queries import scored_table
    s = scored_table(spark, sf)
    return s.select("InvoiceID", V.invoice_text(s).alias("text"))


@register("explain_invoices")
def q_explain_invoices(spark, sf):
    """K6 for one invoice of every vendor, asked by a question."""
    from tallyhawk.plans.invoice_queries import focus_ids, scored_table
    s = scored_table(spark, sf)
    asked = focus_ids(s).select(F.col("InvoiceID").alias("invoice_id"),
                                F.concat(F.lit("why is invoice "), "InvoiceID", F.lit(" marked as risky?")).alias("question"))
    return V.explain_invoices(s, asked, V.similar_of_vendor(s, asked))
