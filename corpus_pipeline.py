"""From raw documents to packed training sequences.

``STAGES`` are run in order; each works on all rows that the one before it kept, and all but the last return the
columns of the documents. ``run`` writes every stage's rows to the cluster's shared folder and reads them again,
so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worthrank.llm.common import held_out, materialise, table
from worthrank.llm.jaccard_join import link_documents
from worthrank.llm.line_dedup import dedup_lines
from worthrank.llm.mixing import mix
from worthrank.llm.packing import pack_pieces, token_pieces
from worthrank.llm.queries import PATTERN, RANKS_PATH, SEQUENCE_LENGTH, TOKENIZER_PATH
from worthrank.llm.toxicity import fit, score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.5 go; the classifier learns from the labelled rows outside the held-out
    fold. A null or empty text has the score of no evidence."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = score(docs.withColumnRenamed("score", "own_score") if "score" in docs.columns else docs, fit(docs, labels))
    kept = scored.where(F.col("score") < 0.5).drop("score")
    return kept.toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten characters or more that a document with a smaller id has go from the text; n_chars follows. A
    null text stays null."""
    done = dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    changed = done.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id stays. Documents without words or id are
    linked with nothing and stay."""
    linked = link_documents(docs)
    gone = linked.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is there twice, one that it doesn't take is gone."""
    taken = mix(docs).groupBy(F.col("doc_id").alias("taken_id")).agg(F.max("copies").alias("copies")).where("copies > 0")
    joined = docs.join(taken, docs["doc_id"].cast("long").eqNullSafe(F.col("taken_id")))
    return joined.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[docs[c] for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in sequences; both copies of a document are packed."""
    return pack_pieces(token_pieces(docs, RANKS_PATH, PATTERN, SEQUENCE_LENGTH, tokenizer_path=TOKENIZER_PATH), SEQUENCE_LENGTH)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_duplicates", drop_near_duplicates),
    ("source_mixing", mix_sources), ("packing", pack_sequences),
]
#: SQL can't express a fitted classifier or byte-pair tokens; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
