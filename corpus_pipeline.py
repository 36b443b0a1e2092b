"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import linking, op4_packing, op5_toxicity, op6_secrets, op8_mixing, op9_dedup
from folioscope.llm.common import delete, hold, scratch, shared_folder, staged


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model grades toxic go."""
    model = op5_toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op5_toxicity.without_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, likeness 0.8 or more) stays: the smallest doc_id.

    Different texts under one doc_id are documents of their own, of which the one with the smallest hash stays if they
    are in one group.  Rows that repeat doc_id and text are copies, of which one stays.  Texts under a null doc_id are
    compared for being equal only.  A row is held in a struct on its way, so no column's name can clash.
    What goes, and what is repeated, is found by ids and hashes; they are joined to the texts once.
    """
    answer = op9_dedup.classified(docs, size=5, part=80, whole=100).where("doc_id is not null")
    several = answer.where("kept and own_text is not null")
    first = several.groupBy("group_id").agg(F.min("own_text").alias("stays"))
    later = several.join(first, "group_id").where("own_text > stays")
    gone = answer.where("not kept").select("doc_id", "own_text").unionByName(later.select("doc_id", "own_text")).distinct()
    gone = staged(gone.select(F.col("doc_id").alias("gone_id"), F.col("own_text").alias("gone_text")), "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), linking.text_hash().alias("short"), F.sha2("text", 256).alias("content"))
    again = staged(rows.groupBy("id", "content").count().where("count > 1").select(F.col("id").alias("same_id"), F.col("content").alias("same_content")), "copies")
    stay = rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("gone_text").isNull() | (F.col("gone_text") == F.col("short"))), "left_anti")
    if again.isEmpty():
        return stay.select("row.*")
    same = F.col("id").eqNullSafe(F.col("same_id")) & F.col("content").eqNullSafe(F.col("same_content"))
    marked = stay.join(again.withColumn("repeated", F.lit(True)), same, "left")
    once = marked.where("repeated is null").unionByName(marked.where("repeated").dropDuplicates(["id", "content"]))
    return once.select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return op6_secrets.redacted(docs, op6_secrets.learn(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return op8_mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 2048."""
    return op4_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: The stages are models, hashing and tokenizers; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread; the last one's rows."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark)}/folioscope/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}-{i}-{name}"
        with scratch():  # what a stage has staged for itself, and its input, go when it is written
            stage(spark, docs, sf_dir).write.parquet(path)
        delete(before)
        docs, before = spark.read.parquet(hold(spark, path)), path
    return docs
