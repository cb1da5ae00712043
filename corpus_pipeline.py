"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustkpi.llm import classifier, decontamination, mixing, sharding, simhash
from trustkpi.llm.queries import MIX, domain
from trustkpi.llm.shared import table
from trustkpi.session import shared_dir, staged_for


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The columns ``names``, and all others in one struct, so that no name can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, (F.struct(*rest) if rest else F.lit(0)).alias("_rest"))


def _unpacked(rows: DataFrame, docs: DataFrame, *names: str) -> DataFrame:
    return rows.select(*[F.col(c) if c in names else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts; it learns from the labels of documents that are not held out."""
    rows = _packed(docs, "doc_id", "text")
    kept = classifier.classify(rows, table(spark, sf_dir, "labels")).where("predicted = 1")
    return _unpacked(kept, docs, "doc_id", "text")


def _row_digest(docs: DataFrame) -> Column:
    """Digest of all columns of a row: only rows that are equal in every column share it."""
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    return F.sha2(F.concat_ws("|", others, F.coalesce(F.sha2("text", 256), F.lit("null"))), 256)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least id (nulls last), then the least digest of its row.

    Of rows that are equal in every column one stays.
    """
    keyed = docs.withColumn("_key", _row_digest(docs))
    rows = _packed(keyed, "doc_id", "text", "_key")
    found = simhash.near_duplicates(rows, carry=("_key",))
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_key"))
    stays = found.groupBy("root").agg(F.min(first).alias("first")).select(F.col("first._key").alias("_key"))
    kept = rows.join(stays.hint("merge"), "_key", "left_semi").dropDuplicates(["_key"])
    return _unpacked(kept, docs, "doc_id", "text")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's passages do not contaminate."""
    rows = _packed(docs, "text")
    kept = decontamination.find_overlaps(rows, table(spark, sf_dir, "benchmark")).where("NOT contaminated")
    return _unpacked(kept, docs, "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights; one drawn in two epochs is there twice."""
    names = ("doc_id", "lang", "source", "text")
    return _unpacked(mixing.mix(_packed(docs, *names), MIX, domain()), docs, *names)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("sharding", shards),
]
# The classifier, the fingerprints' XXH64 and the label propagation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, apply) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}-{name}"
        with staged_for(spark):
            apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
