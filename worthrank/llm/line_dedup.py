"""Line de-duplication over levelled sorted runs of line hashes.

The documents come in batches of rising ids. The state is a set of runs, each a table of distinct line
hashes with the smallest id that has the line, bucketed and sorted by the hash. A batch's own distinct hashes are
merge-anti-joined with every run, which needs no shuffle of the runs; what remains is new and becomes a run of
the lowest level. When a level has as many runs as the fan-out, they are merged into one of the next.
As batches come in the order of ids, a hash's run names the document that keeps the line.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worthrank.llm.common import map_arrow, materialise, text_batches
from worthrank.session import scratch_path

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """A 16-byte hash of the line without white space at its ends and with A-Z in lower case; None if it
    has fewer than ``least_chars`` code points."""
    key = line.strip(SPACES).lower()
    if len(key) < least_chars or len(key) < 4 * least_chars and len(key.decode("utf-8", "replace")) < least_chars:
        return None
    return blake2b(key, digest_size=16).digest()


def line_keys(docs: DataFrame, least_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2): the distinct hashes of every document's lines, as two longs. Rows without id, and null or
    empty texts, have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {line_key(x, least_chars) for x in text.split(b"\n")} - {None}
                ids.extend([doc] * len(own))
                keys.extend(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array([int.from_bytes(k[a : a + 8], "little", signed=True) for k in keys], pa.int64()) for a in (0, 8))],
                names=["doc_id", "k1", "k2"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_arrow(rows.where("doc_id is not null and text is not null"), run, "doc_id long, k1 long, k2 long")


class SortedRuns:
    """Runs of (k1, k2, first) by level, as bucketed and sorted tables in the cluster's shared folder."""

    def __init__(self, spark: SparkSession, buckets: int, fan_out: int = 3):
        self.spark, self.buckets, self.fan_out = spark, buckets, fan_out
        self.levels: list[list[DataFrame]] = []

    def write(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, "k1", "k2").write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2")
         .option("path", scratch_path(self.spark, name)).format("parquet").saveAsTable(name))
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, firsts: DataFrame) -> None:
        """Add the rows of (k1, k2, first) whose hash no run has, then compact full levels."""
        new = firsts
        for run in self.runs():
            new = new.join(run.select("k1", "k2").hint("merge"), ["k1", "k2"], "left_anti")
        self._put(0, self.write(new))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            merged = self.levels[level][0]
            for other in self.levels[level][1:]:
                merged = merged.unionByName(other)  # no hash is in two runs
            self.levels[level] = []
            self._put(level + 1, self.write(merged))

    def table(self) -> DataFrame:
        runs = self.runs()
        whole = runs[0]
        for run in runs[1:]:
            whole = whole.unionByName(run)
        return whole


def batch_bounds(docs: DataFrame, batches: int, id_col: str = "doc_id") -> list[int]:
    """The lowest ids of all batches but the first, so that batches have about equally many rows."""
    cuts = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [k / batches for k in range(1, batches)], 10_000).alias("q")).first()["q"]
    return sorted({c + 1 for c in cuts}) if cuts else []


def dedup_lines(docs: DataFrame, least_chars: int = 10, batches: int = 4, fan_out: int = 3, bucket_keys: int = 1_000_000,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text (replacing columns of those names).

    A text is split at newlines; a null or empty text is one empty line. A line whose key (see ``line_key``)
    occurs in a document with a smaller id goes; a document's own repeats of a line stay or go together. kept_text
    joins the lines that stay by newlines. Rows with a null id lose nothing; rows that share an id count as one
    document. ``batches`` documents' ranges of ids are deduplicated one after the other; the result doesn't depend
    on their number. Whole texts are shuffled once, to meet the hashes that their lines lose."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    bounds = batch_bounds(docs, batches, id_col)
    batch = sum([(F.col("doc_id") >= b).cast("int") for b in bounds], F.lit(0))
    path = scratch_path(spark, "line-keys")
    line_keys(docs, least_chars, id_col, text_col).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    keys = spark.read.schema("doc_id long, k1 long, k2 long, batch int").parquet(path)
    state = SortedRuns(spark, max(1, -(-keys.count() // bucket_keys)), fan_out)
    for b in range(len(bounds) + 1):
        own = keys.where(F.col("batch") == b)
        state.add(own.groupBy("k1", "k2").agg(F.min("doc_id").alias("first")))
    # every hash is in one run, with the document that keeps the line; a hash that many documents have is one skewed
    # key of a plain join, which adaptive execution splits
    later = keys.join(state.table(), ["k1", "k2"]).where(F.col("doc_id") != F.col("first"))
    lost = materialise(later.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("__lost")), "lost-lines")
    joined = docs.join(lost.withColumnRenamed("doc_id", "__lost_id"), F.col(id_col).cast("long") == F.col("__lost_id"), "left").drop("__lost_id")
    at, lost_at = docs.columns.index(text_col), len(docs.columns)
    schema = docs.select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.lit("").alias("kept_text")).schema

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(found):
            lines, dropped, kept = [], [], []
            for text, gone in zip(part.column(at).to_pylist(), part.column(lost_at).to_pylist(), strict=True):
                own = (text or "").split("\n")
                lines.append(len(own))
                if gone:
                    out = {k["k1"].to_bytes(8, "little", signed=True) + k["k2"].to_bytes(8, "little", signed=True) for k in gone}
                    own = [x for x in own if line_key(x.encode(), least_chars) not in out]
                dropped.append(lines[-1] - len(own))
                kept.append("\n".join(own))
            yield pa.RecordBatch.from_arrays([*part.columns[:lost_at], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                                             names=[f.name for f in schema.fields])

    return map_arrow(joined, run, schema)
