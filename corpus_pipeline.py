"""The corpus pipeline: documents through five of the corpus operators, each stage written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.llm import bpe, decontaminate, line_dedup, quality_rules, shingle_join
from sightline.llm.names import fresh
from sightline.operators.support import cut_lineage, shared_folder
from sightline.plans import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    ship_package(spark)
    return quality_rules.keep_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; ``n_chars`` follows the text."""
    cut = line_dedup.drop_boilerplate(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the group's least id (null first).

    Rows are judged by id and text, so rows that share an id do not share a fate. Of rows equal in
    both the least by the other columns stays. Texts without words are copies of nothing and stay.
    """
    ship_package(spark)
    key, number = fresh([*docs.columns, "rank", "group", "n", "kept"], "__key", "__n")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = shingle_join.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).where("n_shingles > 0")
    rows = found.groupBy(F.col("doc_id").alias(key)).agg(F.min("component_id").alias("group"), F.count("*").alias("n"))
    ids = keyed.select(key, "doc_id").distinct()
    rows = cut_lineage(rows.join(ids, key).withColumn("rank", F.struct("doc_id", key)).drop("doc_id"))
    least = rows.groupBy("group").agg(F.min("rank").alias("least"))
    judged = cut_lineage(rows.join(least, "group").select(key, "n", (F.col(f"rank.{key}") == F.col(f"least.{key}")).alias("kept")))
    # The list of dropped rows grows with the input: one plan at every size, never a broadcast.
    out = keyed.join(judged.where("NOT kept OR n > 1").select(key).hint("merge"), key, "left_anti")
    repeated = judged.where("kept AND n > 1").select(key)
    if repeated.limit(1).count():
        order = W.partitionBy(key).orderBy(*(F.col(c).asc_nulls_first() for c in docs.columns if c not in ("doc_id", "text")), key)
        again = keyed.join(repeated, key, "left_semi")
        again = again.withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(number)
        out = out.unionByName(again)
    return out.select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship_package(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document left, and whether they decode to its text."""
    ship_package(spark)
    # Worker processes outlive the stage and serve the other stages too: little is remembered here.
    both = bpe.encode(docs, carry=("doc_id", "text"), decoded=True, max_steps=200_000, max_chunks=200_000)
    return both.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE", tokens),
]

# Token ids of byte-level merges are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
