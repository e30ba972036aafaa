"""Corpus pipeline: filter, de-duplicate, mix and pack ``documents``.

Each stage calls one operator of ``tallyhawk.llm``, takes what the stage before
kept and returns rows with the columns of ``documents``; the last returns the
pieces of the packed sequences. Stage results are written as Parquet and read
again, so a lost executor costs tasks of one stage only. What a stage wrote
for itself is deleted when the next one starts.

Nulls, empty texts, empty tables and repeated rows: as each operator's
docstring says; a document whose text is null passes the filters as an empty
text, is a copy of other empty texts, and takes no part in the mix.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tallyhawk.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from tallyhawk.llm.common import read
from tallyhawk.session import materialize, release_scratch, scratch_tables, ship_package

#: SQL cannot express the learnt filter, nor tokenising: tests hold the stages
#: against brute-force versions instead.
ORACLE_SQL = None

_LEFT: dict[str, list[str]] = {}

#: Texts that go to a Python worker at a time: workers and their buffers stay small beside the JVM.
TEXTS_AT_A_TIME = "1000"


def _stage(f):
    """Delete the previous stage's own tables first, and note those of this one."""
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_AT_A_TIME)
        app = spark.sparkContext.applicationId
        release_scratch(spark, _LEFT.pop(app, []))
        before = scratch_tables(spark)
        out = f(spark, docs, sf_dir)
        if f is not STAGE_LAST:
            _LEFT[app] = [p for p in scratch_tables(spark) if p not in before]
        return out
    return run_stage


def toxicity_filter(spark, docs, sf_dir):
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))


def exact_copies(spark, docs, sf_dir):
    """Of equal texts, the document with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays (five words, similarity 0.8)."""
    return near_dedup.keep_one_each(docs, words=5, percent=80)


def mix_sources(spark, docs, sf_dir):
    """Sources to their target weights: rows repeat, or end at the budget's word."""
    return mixing.mixed_documents(docs)


def pack_windows(spark, docs, sf_dir):
    """Pieces of documents in windows of tokens."""
    import public_tokenizers
    return packing.pack(docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json")).drop("source")


STAGE_LAST = pack_windows
STAGES = [("toxicity", _stage(toxicity_filter)), ("exact dedup", _stage(exact_copies)),
          ("near dedup", _stage(near_copies)), ("mixing", _stage(mix_sources)), ("packing", _stage(pack_windows))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs, held = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        release_scratch(spark, held)
        held = scratch_tables(spark)[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
