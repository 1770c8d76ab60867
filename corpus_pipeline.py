"""A training corpus from raw documents: toxic texts go, one of each group of near copies stays, repeated passages are cut,
contaminated documents go, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; ``run`` writes every stage's result as
Parquet in the shared folder and reads it again, so a lost executor costs a stage's tasks at most."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import decontaminate, jaccard, packing, suffixes
from framewise.llm import toxicity as toxic
from framewise.session import shared_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; learnt from the labelled ones among them."""
    rows = docs.select("doc_id", "text", _others(docs))
    return _whole(docs, toxic.toxicity(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 0"), "others")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 or more connect."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of 200 bytes that occur more than once; ``n_chars`` follows the text."""
    out = suffixes.remove_repeats(docs, payload=_others(docs))
    kept = _whole(docs, out.withColumnRenamed("doc_id", "others"), "others")
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else kept


def _others(docs: DataFrame) -> Column:
    """All columns but the text as one, so that the text travels once and no name clashes with those of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others")


def _whole(docs: DataFrame, rows: DataFrame, others: str) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(others).getField(c).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark windows."""
    return decontaminate.clean_only(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with the digests of their tokens."""
    return packing.digests(docs)


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", near_copies), ("suffix_array_dedup", repeated_passages),
          ("benchmark_decontamination", decontamination), ("packing", packed)]

#: A trained classifier, random paths and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the ``documents`` table to the packed pieces."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
