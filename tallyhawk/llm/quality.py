"""Quality by an interpolated modified Kneser-Ney model over character n-grams of words.

Training: n-grams of all trusted text are counted by language (combined inside
tasks, then aggregated). Lower orders are continuation counts of the order
above; discounts come from the counts of counts of each language and order.
All of it is aggregations and joins of count tables.

Scoring: a batch of texts sends each word, once, to the word's shard, with the
documents and counts that need it, packed into one compressed row for each
(batch, shard). A shard's distinct n-grams are joined with the count tables of
all orders, which gives the probability of each, and of its words; the shard
adds up log-probabilities for each document of each batch. So no task needs
the whole model, and no text is shuffled.

A document is kept if its perplexity (per character, word ends included, drawn
to the language's trusted median by ``PRIOR_CHARS`` characters so that a few
words decide little) is at most a quantile of the trusted documents' own
perplexities in its language.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import small_side
from tallyhawk.session import materialize

ORDER = 5
START, END = "\x02", "\x03"
QUANTILE = 0.985
PRIOR_CHARS = 40
BATCH_BYTES = 4_000_000
SHARD_WORDS = 6_000_000
#: Trusted ids up to which the ids are broadcast (64 MB).
PICK_ROWS = 4_000_000


def _grams(word: str) -> list[str]:
    s = START * (ORDER - 1) + word + END
    return [s[i:i + ORDER] for i in range(len(s) - ORDER + 1)]


def _batches_by_language(pdf: pd.DataFrame):
    """(language, rows) of up to ``BATCH_BYTES`` characters of text."""
    for lang, part in pdf.groupby("lang", sort=True):
        size = part["text"].str.len().cumsum() // BATCH_BYTES
        for _, rows in part.groupby(size, sort=True):
            yield lang, rows


def _count_grams(batches):
    for pdf in batches:
        for lang, rows in _batches_by_language(pdf):
            words: Counter = Counter()
            for t in rows["text"]:
                words.update(t.split())
            grams: dict[str, int] = defaultdict(int)
            for w, n in words.items():
                for g in _grams(w):
                    grams[g] += n
            yield pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())})


def kneser_ney(trusted: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order k: (lang, gram, alpha) and (lang, context, gamma). Columns in: lang, text."""
    counted = trusted.mapInPandas(_count_grams, "lang string, gram string, n long")
    counts = materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "kn-counts")
    model = {}
    for k in range(ORDER, 0, -1):
        if k < ORDER:   # in how many ways is the gram continued to the left?
            counts = materialize(counts.select("lang", F.substring("gram", 2, k).alias("gram"))
                                 .groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), "kn-counts")
        times = lambda m: F.sum((F.col("n") == m).cast("long"))
        of = counts.groupBy("lang").agg(*[times(m).alias(f"t{m}") for m in (1, 2, 3, 4)])
        y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
        discount = lambda m: F.least(F.greatest(F.coalesce(  # noqa: E731  fallbacks for tiny languages
            m - (m + 1) * y * F.col(f"t{m + 1}") / F.col(f"t{m}"), F.lit(0.5 * m)), F.lit(0.05)), F.lit(m - 0.05))
        of = of.select("lang", *[F.when(F.col(f"t{m}") > 0, discount(m)).otherwise(0.5 * m).alias(f"d{m}")
                                 for m in (1, 2, 3)])
        n = F.col("n")
        cut = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        seen = counts.join(F.broadcast(of), "lang") \
            .withColumn("context", F.substring("gram", 1, k - 1)).withColumn("cut", cut)   # one row per language
        contexts = materialize(seen.groupBy("lang", "context").agg(F.sum("n").alias("total"),
                                                                   F.sum("cut").alias("cuts")), "kn-contexts")
        alpha = seen.join(contexts, ["lang", "context"]).select(
            "lang", "gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("alpha"))
        model[k] = (materialize(alpha, "kn-alpha"),
                    contexts.select("lang", "context", (F.col("cuts") / F.col("total")).alias("gamma")))
    return model


def gram_scores(grams: DataFrame, model) -> DataFrame:
    """(lang, gram, logp) of full-order n-grams: interpolation down to the uniform distribution."""
    alphabet = model[1][0].groupBy("lang").agg((1 / (F.count(F.lit(1)) + 1)).alias("p"))
    scored = grams.join(F.broadcast(alphabet), "lang")   # one row per language
    for k in range(1, ORDER + 1):
        alpha, gamma = model[k]
        scored = (scored.withColumn("part", F.substring("gram", ORDER - k + 1, k))
                  .withColumn("context", F.substring("part", 1, k - 1))
                  .join(alpha.withColumnRenamed("gram", "part"), ["lang", "part"], "left")
                  .join(gamma, ["lang", "context"], "left")
                  .withColumn("p", F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p"))
                  .select("lang", "gram", "p"))
    return scored.select("lang", "gram", F.log("p").alias("logp"))


def _zip(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unzip(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bytes(blob))


def _plane(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def _ask(batches, shards: int, part: str):
    """What a batch of texts sends: ``docs``: its documents, ``words``: its distinct words by shard,
    ``uses``: those words and who needs them. Each is asked for where it is needed, under the same batch name."""
    task, nth = TaskContext.get().partitionId(), 0
    for pdf in batches:
        for lang, rows in _batches_by_language(pdf):
            if part == "words":
                names = list(set().union(*map(str.split, rows["text"])))
                if names:
                    yield pd.DataFrame([(s, lang, _zip(" ".join([names[i] for i in at]).encode("utf-8", "surrogatepass")))
                                        for s, at in _by_home(_homes(names, shards))], columns=["shard", "lang", "words"])
                continue
            told = xxhash.xxh3_128()
            for t in rows["text"]:
                told.update(t.encode("utf-8", "surrogatepass"))
                told.update("\x00")
            batch, nth = f"{task}-{nth}-{told.hexdigest()}", nth + 1
            if part == "docs":
                sizes = np.fromiter((sum(map(len, own)) + len(own) for own in map(str.split, rows["text"])), np.int64, len(rows))
                yield pd.DataFrame({"batch": [batch], "lang": [lang], "uses": [
                    rows["doc_id"].to_numpy(np.int64).tobytes() + rows["no_id"].to_numpy(np.int64).tobytes()
                    + sizes.tobytes()]})
                continue
            number: dict[str, int] = defaultdict()
            number.default_factory = number.__len__
            codes = [np.fromiter(map(number.__getitem__, t.split()), np.int64) for t in rows["text"]]
            if not number:
                continue
            names = list(number)
            pairs, counts = np.unique(np.repeat(np.arange(len(codes)), list(map(len, codes))) * len(names)
                                      + np.concatenate(codes), return_counts=True)
            docs, words = np.divmod(pairs, len(names))
            out = []
            for s, at in _by_home(_homes(names, shards)[words]):
                used, local = np.unique(words[at], return_inverse=True)
                out.append((s, batch, lang, _zip(" ".join([names[i] for i in used]).encode("utf-8", "surrogatepass")),
                            _zip(_plane(np.diff(docs[at], prepend=0)) + _plane(local) + _plane(counts[at]))))
            yield pd.DataFrame(out, columns=["shard", "batch", "lang", "words", "uses"])


def _homes(names: list[str], shards: int) -> np.ndarray:
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    return (hashed % np.uint64(shards)).astype(np.int64)


def _by_home(home: np.ndarray):
    """(shard, places of ``home`` that hold it, in order)."""
    order = np.argsort(home.astype(np.uint16) if home.max() < 65536 else home, kind="stable")
    cut = np.flatnonzero(np.diff(home[order], prepend=-1))
    return zip(home[order[cut]].tolist(), np.split(order, cut[1:]))


def _words(blob: bytes) -> list[str]:
    return _unzip(blob).decode("utf-8", "surrogatepass").split(" ")


def _distinct_grams(pdf: pd.DataFrame, shard: int) -> pd.DataFrame:
    out = []
    for lang, rows in pdf.groupby("lang"):
        words = {w for b in rows["words"] for w in _words(b)}
        out.append(pd.DataFrame({"shard": shard, "lang": lang, "gram": list({g for w in words for g in _grams(w)})}))
    return pd.concat(out) if out else pd.DataFrame(columns=["shard", "lang", "gram"], dtype=object)


def _score(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    out = []
    for lang, rows in asked.groupby("lang"):
        own = known[known["lang"] == lang]
        if own.empty:      # a language without trusted text
            continue
        logp = dict(zip(own["gram"], own["logp"]))
        word_score: dict[str, float] = {}
        for batch, blob, uses in zip(rows["batch"], rows["words"], rows["uses"]):
            scores = []
            for w in _words(blob):
                s = word_score.get(w)
                if s is None:
                    s = word_score[w] = sum([logp[g] for g in _grams(w)])
                scores.append(s)
            raw = np.frombuffer(_unzip(uses), np.uint8).reshape(3, -1)
            doc, word, n = (np.ascontiguousarray(p.reshape(4, -1).T).view("<u4").ravel().astype(np.int64) for p in raw)
            total = np.bincount(np.cumsum(doc), weights=np.array(scores)[word] * n)
            out.append((batch, _zip(total.tobytes())))
    return pd.DataFrame(out, columns=["batch", "sums"])


def _add_up(asked: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
    if asked.empty:
        return pd.DataFrame(columns=["doc_id", "no_id", "lang", "n_chars", "logp"], dtype=object)
    ids, missing, sizes = np.frombuffer(asked["uses"].iloc[0], np.int64).reshape(3, -1)
    total = np.zeros(len(ids))
    for blob in sorted(sums["sums"].map(bytes)):   # in a fixed order: the same sum every time
        part = np.frombuffer(_unzip(blob))
        total[:len(part)] += part
    known = len(sums) > 0
    return pd.DataFrame({"doc_id": ids, "no_id": missing > 0, "lang": asked["lang"].iloc[0], "n_chars": sizes,
                         "logp": total if known else np.full(len(ids), np.nan)})


def quality(docs: DataFrame, trusted_ids: DataFrame, *, quantile: float = QUANTILE, id_col: str = "doc_id",
            text_col: str = "text", lang_col: str = "lang", prior_chars: int = PRIOR_CHARS) -> DataFrame:
    """One row per input row: doc_id, lang, n_chars (scored), logp, perplexity, threshold, kept.

    ``trusted_ids``: ids (first column) of the documents whose text is trusted.
    Null texts count as empty; a text without words scores nothing, has the
    perplexity of the language's median and is kept. A null language is a
    language. In a language without trusted text there is no perplexity and no
    threshold, and all documents are kept. Repeated rows are scored alike. Rows are read three
    times, so ``docs`` should be a file scan or a written table. Very long texts are read whole. An
    empty table gives an empty result; other columns are not looked at."""
    source = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(0).cast("long")).alias("doc_id"),
                         docs[id_col].isNull().alias("no_id"),
                         F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"),
                         F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    trusted = materialize(trusted_ids.select(trusted_ids[trusted_ids.columns[0]].cast("long").alias("doc_id"))
                          .where("doc_id is not null").distinct(), "kn-trusted")
    model = kneser_ney(source.where("not no_id").join(small_side(trusted, PICK_ROWS), "doc_id", "left_semi")
                       .select("lang", "text"))
    words = source.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    # asked for three times rather than written, which would take 0.6 x the input of disk: a batch is named
    # by its texts too, so that batches dealt otherwise by a repeated task are never added to one another
    asked = source.mapInPandas(lambda it: _ask(it, shards, "docs"), "batch string, lang string, uses binary")
    by_shard = source.mapInPandas(lambda it: _ask(it, shards, "uses"),
                                  "shard long, batch string, lang string, words binary, uses binary").groupBy("shard")
    wanted = source.mapInPandas(lambda it: _ask(it, shards, "words"), "shard long, lang string, words binary").groupBy("shard").applyInPandas(
        lambda key, pdf: _distinct_grams(pdf, int(key[0])), "shard long, lang string, gram string")
    scores = gram_scores(wanted.select("lang", "gram").distinct(), model)
    known = wanted.join(scores, ["lang", "gram"])
    sums = by_shard.cogroup(known.groupBy("shard")).applyInPandas(_score, "batch string, sums binary")
    totals = materialize(asked.groupBy("batch").cogroup(sums.groupBy("batch"))
                         .applyInPandas(_add_up, "doc_id long, no_id boolean, lang string, n_chars long, logp double"),
                         "kn-scores")
    scored = totals.withColumn("logp", F.when(~F.isnan("logp"), F.col("logp")))
    mean = F.when(F.col("n_chars") > 0, -F.col("logp") / F.col("n_chars"))
    own = (scored.where("not no_id and n_chars > 0 and logp is not null")
           .join(small_side(trusted, PICK_ROWS), "doc_id", "left_semi").withColumn("mean", mean))
    middle = own.groupBy("lang").agg(F.percentile_approx("mean", 0.5, 10000).alias("middle"))
    smooth = ((-F.col("logp") + F.lit(float(prior_chars)) * F.col("middle")) / (F.col("n_chars") + F.lit(prior_chars)))
    top = (own.join(F.broadcast(middle), "lang").groupBy("lang")   # one row per language
           .agg(F.percentile_approx(smooth, quantile, 10000).alias("top")))
    limits = materialize(middle.join(top, "lang"), "kn-limits")
    return (scored.join(F.broadcast(limits), "lang", "left")
            .withColumn("perplexity", F.exp(smooth)).withColumn("threshold", F.exp("top"))
            .withColumn("kept", F.coalesce(smooth <= F.col("top"), F.lit(True)))
            .select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "lang", "n_chars", "logp",
                    "perplexity", "threshold", "kept"))
