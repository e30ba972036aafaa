"""Registered queries of the run, turn-repair and byte-pair operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhawk.llm import byte_bpe, periodic_runs, turn_repair
from tallyhawk.llm.common import WORD, read
from tallyhawk.llm.registry import register


def with_periodic_tails(docs):
    """``docs`` (doc_id, text); with h = crc32(doc_id) and h % 10 = 0, the words from a = (h / 10) % n on
    repeat the first 1 + (n - a) / (3 + (h / 10) % 8) of them."""
    h = F.crc32(F.encode(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), "UTF-8"))
    cut = docs.withColumn("h", h).withColumn("g", F.floor(F.col("h") / 10).cast("long")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))))
    n = F.size("words")
    cut = cut.withColumn("n", n.cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    cut = cut.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.expr("slice(words, int(a) + 1, int(least(p, n - a)))")
    times = F.expr("int(ceil((n - a) / p))")
    again = F.expr("slice(rest, 1, int(n - a))")
    cut = cut.withColumn("rest", F.when(F.col("a").isNotNull(), F.flatten(F.array_repeat(tail, times))))
    text = F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.expr("slice(words, 1, int(a))"), again), " "))
    return cut.select("doc_id", text.alias("text"))


@register("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.run_report(periodic_runs.periodic_runs(with_periodic_tails(docs)))


@register("op12_turn_repair")
def op12_turn_repair(spark, sf_dir):
    conv = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return turn_repair.repair_report(turn_repair.repair(turn_repair.damage(conv)), conv)


@register("op13_byte_bpe")
def op13_byte_bpe(spark, sf_dir):
    import public_tokenizers
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(byte_bpe.encode(docs, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                            pattern=public_tokenizers.PATTERN, decoded=True))
