"""Corpus pipeline: the stages that turn documents into packed training sequences.

Each stage takes the documents that the one before kept and returns their columns, the last one the packed pieces.
Rows with a null id or text pass every filter that does not concern them; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm import mixing, ngram_join, pack, substring, toxicity
from strandwork.llm._store import cut

ORACLE_SQL = None


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labels of these documents, does not find toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(~F.col("toxic")).select(*columns(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, the one with the smallest id (null last) and then text; of repeated rows one."""
    kept = ngram_join.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    rows = docs.withColumn("__text", F.xxhash64(F.col("text").cast("string"))).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")), "left_semi")
    return rows.dropDuplicates(["doc_id", "__text"]).select(*columns(docs))


def remove_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeated passages cover; those with nothing left go."""
    cleaned = substring.remove_repeats(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    cleaned = cleaned.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(*columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents, as many as the mix takes of their words: the part of a copy becomes one copy or none by a seeded hash."""
    keyed = docs.withColumn("__text", F.xxhash64("text"))
    slim = cut(keyed.select("doc_id", "__text", "source", mixing.n_words().alias("size")), "sizes")
    each = mixing.mix(slim).groupBy("doc_id", "__text").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("__times"))
    each = each.select(F.col("doc_id").alias("__id"), F.col("__text").alias("__key"), "__times")
    rows = keyed.join(each, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")))
    whole = F.floor("__times")
    part = F.pmod(F.xxhash64(F.lit(29), "doc_id", "__text"), F.lit(1 << 20)) / F.lit(float(1 << 20)) < F.col("__times") - whole
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), (whole + part.cast("int")).cast("int")))).select(*columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences."""
    return pack.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_near_copies),
    ("substring_dedup", remove_shared_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
