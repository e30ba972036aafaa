"""Toxicity: gradient-boosted trees over dense text features, isotonic calibration.

A lexicon of words is learnt from labelled rows by smoothed log-odds of document
counts; a text's word is a hit if it begins with one of them. Features of a whole text: lexicon densities, how
near lexicon hits stand to second-person words, capitals, punctuation and
obfuscation rates. Trees are fitted on one part of the labelled rows and
calibrated on another. Texts are scored where they lie; nothing but the
lexicon and the model leaves the training rows.
"""

from __future__ import annotations

import bisect
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyhawk.session import materialize

#: Labelled rows of each class that are used at most, in order of a hash of the id.
ROWS_PER_CLASS = 4000
LEXICON_SIZE = 256
MIN_DOCS = 6
MIN_LOG_ODDS = 2.5
NEAR_WORDS = 5
HELD_OUT, CALIBRATION, FOLDS = 2, 3, 4
THRESHOLD = 0.3
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi vous votre vos du dich dir dein deine ihr euch "
                          "tú ti usted ustedes vosotros tus".split())
#: Common stand-ins for letters.
_PLAIN = str.maketrans("0134578@$", "oieastbas")
_CAPS = re.compile(r"\b[^\W\d_]{2,}\b")
_OBFUSCATED = re.compile(r"[^\W\d_][\d@$*%&#+._-]+[^\W\d_]")
_EDGES = re.compile(r"^\W+|\W+$")
FEATURES = ("log_words", "hits", "density", "weight_density", "max_weight", "distinct_hits", "near_rate", "near_hits",
            "second_person", "capitals", "caps_words", "punctuation", "exclamations", "digits", "obfuscated",
            "symbols", "word_length", "distinct_words", "longest_run")
_KIND = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (1 if "A" <= _c <= "Z" else 2 if "0" <= _c <= "9" else 3 if _c == "!" else 4 if _c in ".,;:?'\"()-"
                 else 5 if 0x21 <= _b < 0x7F and not _c.isalnum() else 0)


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(FOLDS))


def _tokens(text: Column) -> Column:
    """Distinct lower-case words, punctuation at their ends removed."""
    words = F.filter(F.transform(F.split(F.lower(text), r"\s+"),
                                 lambda w: F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", "")), lambda w: w != "")
    return F.array_distinct(words)


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Words that mark label 1 (columns text, label): at most ``size``, with log-odds."""
    ones, total = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    ones, total = ones or 0, total or 0
    counts = (rows.select("label", F.explode(_tokens(F.col("text"))).alias("token")).groupBy("token")
              .agg(F.sum("label").alias("in"), F.count(F.lit(1)).alias("n")))
    odds = F.log((F.col("in") + 0.5) / (ones + 1.0)) - F.log((F.col("n") - F.col("in") + 0.5) / (total - ones + 1.0))
    best = (counts.where(F.col("in") >= MIN_DOCS).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
            .orderBy(F.col("odds").desc(), "token").limit(size))
    return {r["token"]: float(r["odds"]) for r in best.collect()}


def _automaton(lexicon: dict[str, float]):
    a = ahocorasick.Automaton()
    for token, odds in lexicon.items():
        a.add_word(" " + token, (token, odds))
    if lexicon:
        a.make_automaton()
    return a if lexicon else None


def text_features(text: str, automaton) -> list[float]:
    """The features of one text, in order of ``FEATURES``."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=6) if len(raw) else np.zeros(6, int)
    chars = max(1, len(text))
    words = text.lower().split()
    n = max(1, len(words))
    clean = [_EDGES.sub("", w) if not w.isalpha() else w for w in words]
    line = " " + " ".join(clean).translate(_PLAIN)
    hits: dict[int, tuple[str, float]] = {}
    if automaton is not None:
        for end, (token, odds) in automaton.iter(line):
            start = end - len(token)
            if odds > hits.get(start, ("", -1.0))[1]:
                hits[start] = (token, odds)
    you = [i for i, w in enumerate(clean) if w in SECOND_PERSON]
    near = 0
    if hits and you:
        starts = [0]
        for w in clean:
            starts.append(starts[-1] + len(w) + 1)
        for at in hits:
            i = bisect.bisect_right(starts, at) - 1
            k = bisect.bisect_left(you, i - NEAR_WORDS)
            near += k < len(you) and you[k] <= i + NEAR_WORDS
    weights = [o for _, o in hits.values()]
    caps = sum(w.isupper() for w in _CAPS.findall(text))
    run = best = 1
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 1
        best = max(best, run)
    return [np.log1p(len(words)), len(hits), len(hits) / n, sum(weights) / n, max(weights, default=0.0),
            len({t for t, _ in hits.values()}), near / n, near, len(you) / n, kinds[1] / chars, caps / n,
            (kinds[3] + kinds[4]) / chars, kinds[3] / n, kinds[2] / chars, len(_OBFUSCATED.findall(text)) / n,
            kinds[5] / chars, chars / n, len(set(words)) / n, best / n]


#: Texts whose features are computed at a time.
FEATURE_ROWS = 500


def add_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``docs`` (with a column text) and one column for each feature; all other columns unchanged."""
    def run(batches):
        automaton = _automaton(lexicon)
        for batch in (b.slice(at, FEATURE_ROWS) for b in batches for at in range(0, b.num_rows, FEATURE_ROWS)):
            x = np.array([text_features(t, automaton) for t in batch.column("text").to_pylist()], dtype=float)
            x = x.reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(np.ascontiguousarray(c)) for c in x.T)], [*batch.schema.names, *FEATURES])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(c, DoubleType()) for c in FEATURES)]))


def training_rows(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """doc_id, text, label, fold, weight of at most ``rows_per_class`` labelled rows of each
    class outside the held-out part, those with the smallest hash of the id.

    ``weight`` restores the classes' shares. Labels other than 0 and 1, and a
    document's labels that contradict each other, are left out."""
    known = (labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
             .where("id is not null and label in (0, 1)").groupBy("id")
             .agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top")
             .withColumn("fold", fold(F.col("id"))).where(F.col("fold") != HELD_OUT)
             .select("id", "label", "fold"))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = []
    for label in (0, 1):
        taken = min(rows_per_class, shares.get(label, 0))
        parts.append(known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(rows_per_class)
                     .withColumn("weight", F.lit(shares.get(label, 0) / max(1, taken))))
    sample = F.broadcast(materialize(parts[0].union(parts[1]), "tox-sample"))   # 2 * rows_per_class rows at most
    return (docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("id"))
            .dropDuplicates(["doc_id"]).select("doc_id", "text", "label", "fold", "weight"))


class ToxicityModel:
    """Lexicon, trees and calibration; ``score`` adds held_out, score and predicted."""

    def __init__(self, lexicon, trees, calibration, prior):
        self.lexicon, self.trees, self.calibration, self.prior = lexicon, trees, calibration, prior

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` (doc_id, text, ...) with held_out, score and predicted; a null text is read as empty."""
        if self.trees is None:
            scored = docs.withColumn("score", F.lit(float(self.prior)))
        else:
            wide = VectorAssembler(inputCols=list(FEATURES), outputCol="tox_x").transform(
                add_features(docs, self.lexicon)).drop(*FEATURES)
            raw = self.trees.transform(wide).withColumn("tox_p", vector_to_array("probability")[1])
            raw = raw.drop("tox_x", "rawPrediction", "probability", "prediction")
            scored = self.calibration.transform(raw).withColumnRenamed("prediction", "score").drop("tox_p")
        return (scored.withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)))
                .withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))))
                .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def fit(docs: DataFrame, labels: DataFrame, *, trees: int = 30, depth: int = 4,
        rows_per_class: int = ROWS_PER_CLASS) -> ToxicityModel:
    """Fit on labelled rows outside the held-out part. With no labelled rows of one
    of the classes, every score is the share of label 1 (0 without labels)."""
    rows = materialize(training_rows(docs, labels, rows_per_class).withColumn("text", F.coalesce("text", F.lit(""))),
                       "tox-train").coalesce(4)
    fitted, held = rows.where(F.col("fold") != CALIBRATION), rows.where(F.col("fold") == CALIBRATION)
    seen = [part.agg(F.sum(F.col("label") * F.col("weight")), F.sum("weight"), F.min("label"), F.max("label")).first()
            for part in (fitted, held)]
    if any(s[2] != 0 or s[3] != 1 for s in seen):
        weight = sum(s[1] or 0 for s in seen)
        return ToxicityModel({}, None, None, sum(s[0] or 0 for s in seen) / weight if weight else 0.0)
    lexicon = learn_lexicon(fitted)
    wide = VectorAssembler(inputCols=list(FEATURES), outputCol="tox_x").transform(add_features(rows, lexicon))
    wide = materialize(wide.select("tox_x", F.col("label").cast("double").alias("label"), "fold", "weight"),
                       "tox-features").coalesce(2)
    model = GBTClassifier(featuresCol="tox_x", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth,
                          stepSize=0.2, minInstancesPerNode=8, seed=17).fit(wide.where(F.col("fold") != CALIBRATION))
    raw = (model.transform(wide.where(F.col("fold") == CALIBRATION))
           .withColumn("tox_p", vector_to_array("probability")[1]).select("tox_p", "label", "weight"))
    calibration = IsotonicRegression(featuresCol="tox_p", labelCol="label", weightCol="weight").fit(raw)
    return ToxicityModel(lexicon, model, calibration, None)


def toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """One row per input row (doc_id, text): doc_id, held_out, score, predicted.

    Null texts count as empty and get a score like any other; texts of any
    length are read whole. Repeated rows get equal scores; a null id is not
    held out. An empty table gives an empty result. Other columns of ``docs``
    are not looked at."""
    return (fit(docs, labels, **params).score(docs.select("doc_id", "text"))
            .select("doc_id", "held_out", "score", "predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """``docs`` without the documents predicted toxic, all columns unchanged."""
    model = fit(docs, labels, **params)
    # under neutral names, so that no input column clashes with a feature
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", *[docs[c].alias(f"in_{i}") for i, c in enumerate(others)])
    kept = model.score(rows).where("predicted = 0").drop("held_out", "score", "predicted")
    back = kept.withColumnsRenamed({f"in_{i}": c for i, c in enumerate(others)})
    return back.select(*[back[c] for c in docs.columns])
