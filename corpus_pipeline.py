"""The corpus pipeline: quality, line dedup, near-duplicates, mixing, packing; each stage's output is the next one's documents.

Every stage but the last returns the columns of documents. Clean documents pass the first stage; lines go, not documents, in
the second; the third keeps one row of each group of near copies, the one of least id (rows are told apart by their place, so
rows of one id or of none are documents each); the fourth puts the documents in the mixed order; the last packs consecutive runs of that order and returns one row for each
piece with its bin, numbered in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruletide.llm import dsir, jaccard, linefreq, mixing, packing
from ruletide.llm.places import placed, whole
from ruletide.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dsir.drawn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linefreq.drop_boilerplate(docs, keep_whole=True)  # a copied page goes as a near copy, but for one
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs, part, at = placed(docs)
    # a row's own key: ids may be null or repeated; the least one of a group is its least id, nulls last
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(part).alias("part"), at.alias("at"))
    rows = docs.select(whole(docs).alias("row"), key.alias("key"), F.col("text").alias("text"))
    found = jaccard.near_duplicates(rows, "key", "text", key_col="key")
    return rows.drop("text").join(found.where("id = component").select(F.col("id").alias("key")), "key", "left_semi").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.mix(docs, carry=tuple(docs.columns))
    carried = [F.col("__row").getField(c).alias(c) for c in docs.columns]
    return mixing.in_order(out.select("__row", "slot", "start", "slots")).select(*carried)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs, ordered=True).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixed), ("packing", packed)]

#: The models and the schedule are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = docs.checkpoint()
    return docs
