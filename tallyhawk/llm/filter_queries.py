"""Registered queries of the scoring, extraction and near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhawk.llm import embedding_dedup, html_text, near_dedup, quality, substring_dedup, toxicity
from tallyhawk.llm.common import read
from tallyhawk.llm.registry import register

PASSAGE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM p WHERE i + 12 <= len(w)),
m AS (SELECT g, min(doc_id) AS f FROM g GROUP BY g HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT DISTINCT g.doc_id, g.i + o.o AS i FROM g JOIN m USING (g), (SELECT unnest(range(0, 13)) AS o) o
        WHERE m.f < g.doc_id),
k AS (SELECT p.doc_id, p.i, p.w[p.i] AS word, hit.i IS NOT NULL AS gone
      FROM p LEFT JOIN hit ON p.doc_id = hit.doc_id AND p.i = hit.i),
a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(a.n_removed, 0) AS n_removed,
       sha256(coalesce(a.kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""


@register("op10_repeated_passages", PASSAGE_SQL)
def op10_repeated_passages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring_dedup.drop_repeated_passages(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS sh
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
      GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

EMBED_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""


@register("op7_near_dedup", NEAR_SQL)
def op7_near_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_groups(docs, words=2, percent=80)


@register("op5_embedding_dedup", EMBED_SQL)
def op5_embedding_dedup(spark, sf_dir):
    return embedding_dedup.embedding_groups(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@register("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.toxicity(docs, labels)


@register("op3_main_text")
def op3_main_text(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.main_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))


@register("op6_quality_perplexity")
def op6_quality_perplexity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    trusted = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.quality(docs, trusted)
