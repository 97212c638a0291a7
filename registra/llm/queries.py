"""The registered queries of the corpus operators, each over its whole tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.llm import chat_format, decontam, exact_dedup, langid, line_dedup, mixing, ngram_join, quality, sharding, sql, toxicity
from registra.llm.common import ROWS_A_FILE, parts_for, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def digests(found: DataFrame, rows: int) -> DataFrame:
    """Short rows, dealt once more: as many files as they need, not one for each partition of the texts."""
    short = found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    return short.repartition(parts_for(rows, ROWS_A_FILE, found.sparkSession.sparkContext.defaultParallelism))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = line_dedup.line_dedup(docs)
    return digests(found, docs.count())


def op2_line_dedup_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that is not blank is a run of its own, however short: all its later repeats go."""
    docs = table(spark, sf_dir, "documents")
    found = line_dedup.line_dedup(docs, chars=1)
    return digests(found, docs.count())


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control.alias("text"))
    turns = chat_format.canonical(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    done = chat_format.format_turns(turns).withColumn("_t", chat_format.read_back(F.col("formatted"))).withColumn("_l", chat_format.loss_text(F.col("formatted"), F.col("loss_mask")))
    flat = F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("conv_id", F.size("_t").cast("long").alias("n_turns"), sha(flat).alias("turns_sha256"), F.length("_l").cast("long").alias("loss_chars"), sha(F.col("_l")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_line_dedup, op2_line_dedup_single, op3_chat_format, op4_sharding, op5_ngram_join, op6_decontamination, op7_quality, op8_toxicity, op9_language_id, op10_mixing)}
SQL = {"op1_exact_dedup": sql.EXACT_DEDUP, "op2_line_dedup": sql.line_dedup(line_dedup.CHARS), "op2_line_dedup_single": sql.line_dedup(1), "op3_chat_format": sql.CHAT_FORMAT, "op5_ngram_join": sql.NGRAM_JOIN, "op6_decontamination": sql.decontamination(decontam.WINDOW), "op10_mixing": sql.MIXING}
