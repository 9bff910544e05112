"""The driver's parquet tables and the ranking views built on them (FIXTURES G1-G5).

Every view reads whole tables; Catalyst prunes columns and pushes predicates into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worthrank.functions.scalar import binarize

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def labelled_documents(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """G1: topic = documents.source, item = doc_id, score = (n_chars % 97) / 97, tie order = doc_id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    return (d.join(lab, "doc_id")
            .select(F.col("source").alias("topic_id"), F.col("doc_id").alias("item_id"),
                    F.col("label"), ((F.col("n_chars") % 97).cast("double") / 97.0).alias("score"),
                    F.col("doc_id").alias("pos"), F.col("lang")))


def order_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic = o_orderpriority, item = o_orderkey, label = status 'F', score = o_totalprice."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("topic_id"), F.col("o_orderkey").alias("item_id"),
                    binarize(F.when(F.col("o_orderstatus") == "F", 1)).alias("label"),
                    F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("pos"))


def event_predictions(spark: SparkSession, sf_dir: str, threshold: float = 250.0,
                      scale: float = 50.0) -> DataFrame:
    """true = event_type 'purchase'; logits z0 = 0, z1 = (value - threshold) / scale."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value",
                    binarize(F.when(F.col("event_type") == "purchase", 1)).alias("label"),
                    F.lit(0.0).alias("z0"), ((F.col("value") - threshold) / scale).alias("z1"))


def supplier_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic = l_suppkey, label = returnflag 'R', score = l_extendedprice.

    (l_orderkey, l_linenumber) is not unique, so the tie order adds l_partkey and the label
    itself: rows still tied after that carry equal labels and cannot change any metric.
    """
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("topic_id"),
                     binarize(F.when(F.col("l_returnflag") == "R", 1)).alias("label"),
                     F.col("l_extendedprice").alias("score"),
                     F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))


SUPPLIER_TIE_ORDER = [("l_orderkey", "asc"), ("l_linenumber", "asc"), ("l_partkey", "asc"), ("label", "asc")]
