"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worthrank.session import scratch_path, ship_package

#: The white space that separates words everywhere in this subpackage, as a regular expression
#: class: space and the controls from tab to carriage return. ``bytes.split()`` splits on the same.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the cluster's shared folder and read it back: a lineage cut that
    survives the loss of executors, and a table whose columns can be pruned."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows no model of this subpackage learns from: crc32(id as text) mod folds is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with this package made importable in the Python workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def text_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into smaller ones, so that a task holds few texts as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's context cleaner delete the shuffle files of finished steps now. It does so when the
    driver's garbage collector finds that nothing refers to them, which otherwise may take many minutes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
