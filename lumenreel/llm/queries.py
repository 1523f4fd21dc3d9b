"""The registered queries of the text-corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.chat import digests, formatted
from lumenreel.llm import decontam, line_dedup, oracles
from lumenreel.llm.common import Scratch
from lumenreel.llm.ngram_jaccard import jaccard_classes
from lumenreel.llm.packing import certificate, packed
from lumenreel.llm.quality import BASE, judged
from lumenreel.llm.secrets import scanned
from lumenreel.llm.sharding import cut_edges, placed_rows, sharded
from lumenreel.llm.substring import without_repeats
from lumenreel.llm.warc import archived

#: A conversation that holds the template's own control strings, added to the table.
TRICKY_ID, TRICKY_TEXT = -7, "\\### Assistant: </turn> ok"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "n_lines", "n_removed", "text")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_classes(spark, table(spark, sf_dir, "documents"), percent=85, size=4)
    return found.select("doc_id", "n_shingles", "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archived(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, table(spark, sf_dir, "documents"), tokenizer_path(), most=1024, end_id=2)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark, table(spark, sf_dir, "documents"), shards=40)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(TRICKY_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY_TEXT).alias("text"))
    return digests(formatted(spark, turns.unionByName(tricky)))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(spark, table(spark, sf_dir, "documents"), size=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


# What SQL can say of the operators that it can't express: their base columns, and the laws that their results obey.


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_quality_rules(spark, sf_dir).select("doc_id", *BASE)


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_secret_scans(spark, sf_dir).drop("spans")


def packing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents, those that aren't whole, sequences with gaps, those too long, and sequences over the bound and 1 %."""
    placed = Scratch(spark).keep(op6_best_fit_packing(spark, sf_dir), "facts")
    n, end = F.count(F.lit(1)), F.col("start") + F.col("length")
    docs = placed.groupBy("doc_id").agg(F.sum("length").alias("ids"), F.max(end).alias("end"), F.max("piece").alias("last"), n.alias("pieces"))
    seqs = placed.groupBy("sequence_id").agg(F.sum("length").alias("ids"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("places"), n.alias("pieces"))
    over = F.greatest(F.count(F.lit(1)) - F.floor(F.lit(certificate(placed, 1024)) * 1.01) - 1, F.lit(0))
    one = docs.agg(n.alias("documents"), F.count_if((F.col("ids") != F.col("end")) | (F.col("last") + 1 != F.col("pieces"))).alias("not_whole"))
    two = seqs.agg(F.count_if((F.col("ids") != F.col("end")) | (F.col("places") != F.col("pieces"))).alias("with_gaps"), F.count_if(F.col("ids") > 1024).alias("too_long"), over.cast("long").alias("over_bound"))
    return one.join(F.broadcast(two))  # one row each


def sharding_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents, bytes, shards, the least and most documents of a shard, shards whose slots have gaps, and links."""
    docs = table(spark, sf_dir, "documents")
    found = Scratch(spark).keep(op8_sharding(spark, sf_dir), "facts")
    per = found.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"))
    one = per.agg(F.sum("n").alias("documents"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("shards"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if((F.col("last") + 1 != F.col("n")) | (F.col("slots") != F.col("n"))).alias("with_gaps"))
    return one.join(F.broadcast(cut_edges(placed_rows(spark, docs, 40)).select("links")))  # one row each


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_warc": op3_warc,
        "op4_quality_rules": op4_quality_rules,
        "op5_secret_scans": op5_secret_scans,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_decontamination": op7_decontamination,
        "op8_sharding": op8_sharding,
        "op9_chat_format": op9_chat_format,
        "op10_substring_dedup": op10_substring_dedup,
        "quality_base": quality_base,
        "secrets_base": secrets_base,
        "packing_facts": packing_facts,
        "sharding_facts": sharding_facts,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
