"""Documents as ordered sequences with their content, without an array per document.

The rows are range-partitioned on (document, order), so a document that holds a third of all rows spans many partitions.
The partition number becomes a column of the checkpointed frame; within (document, partition) positions and neighbours come
from windows that stream over sorted rows, and what lies beyond a partition's ends from a table with a row per document and
partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worthrank.session import checkpoint_dir


def document_sequences(df: DataFrame, doc_col: str, order: Sequence[str], neighbour_col: str, partitions: int | None = None) -> DataFrame:
    """Add ``pos`` (from 1), ``n_in_doc``, ``previous`` and ``next`` (``neighbour_col`` of the rows before and after, NULL at the ends) to
    every row of a document. ``order`` should be a total order; rows with equal values are in any order, but the
    neighbours agree with the positions. A NULL document is one document. ``partitions`` fixes the number of ranges."""
    checkpoint_dir(df.sparkSession)
    keys = [doc_col, *order]
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    # the row's own number makes the order total, and is data once it is checkpointed
    held = spread.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()).checkpoint(eager=True)
    own = [F.col(c) for c in (*order, "_row")]
    w = Window.partitionBy(doc_col, "_part").orderBy(*own)
    local = held.select("*", F.row_number().over(w).cast("bigint").alias("_at"), F.lag(neighbour_col).over(w).alias("_before"), F.lead(neighbour_col).over(w).alias("_after"))
    place, value = F.struct(*own), F.struct(F.col(neighbour_col).alias("v"))
    ends = held.groupBy(doc_col, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min_by(value, place).alias("_first"), F.max_by(value, place).alias("_last"))
    doc = Window.partitionBy(doc_col)
    parts = doc.orderBy("_part")
    ends = ends.select(
        F.col(doc_col).alias("_doc"), F.col("_part").alias("_p"), "_n", F.sum("_n").over(doc).alias("n_in_doc"),
        F.coalesce(F.sum("_n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_sum"),
        F.lag("_last").over(parts)["v"].alias("_from"), F.lead("_first").over(parts)["v"].alias("_to"))
    joined = local.join(ends, (F.col("_part") == F.col("_p")) & F.col(doc_col).eqNullSafe(F.col("_doc")))
    return joined.select(
        *df.columns, (F.col("_sum") + F.col("_at")).alias("pos"), "n_in_doc",
        F.when(F.col("_at") == 1, F.col("_from")).otherwise(F.col("_before")).alias("previous"),
        F.when(F.col("_at") == F.col("_n"), F.col("_to")).otherwise(F.col("_after")).alias("next"))
