"""Structured Streaming extensions (X1, X2): the 2020 task ranks a *stream* of posts.

* X1 ``stream_score``: a fitted model's ``transform`` on a streaming frame (stateless), written
  to a file sink with exactly-once checkpointing.
* X2 ``stream_window_counts``: per type, tumbling event-time windows of scored / positive rows,
  with a watermark bounding state; the complete result table is rewritten per micro-batch.

Checkpoints and sink files live under the shared checkpoint directory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worthrank.session import scratch_path


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table of the test-data directory as a stream source (schema from the files). The table is a folder
    of part files, which is the stream's folder then, or a single file: a stream's path must be a folder or a
    pattern, and the pattern here is met by that file alone, so no other table's folder is listed."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).isDirectory(at):
        return r.parquet(path)
    return r.parquet(path.removesuffix("t") + "[t]")


def run_to_files(stream: DataFrame, name: str, output_mode: str = "append") -> str:
    """Run a streaming frame until all available input is processed; returns the sink path.
    Append mode uses the file sink; complete mode rewrites the result per micro-batch.

    A stateful query keeps one state store per shuffle partition for its whole life (the number
    is fixed in its checkpoint at the first start): the session's ``spark.sql.shuffle.partitions``. A caller that
    wants another number starts the stream from a session of its own (``spark.newSession()``)."""
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    w = stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if output_mode == "append":
        q = w.format("parquet").option("path", out).outputMode("append").start()
    else:
        def write_batch(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(out)
        q = w.foreachBatch(write_batch).outputMode(output_mode).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return out


def run_arrivals(arrivals: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, list[dict]]:
    """X2 as a job that is started again whenever data has come: each frame is written to the stream's folder, then the stream,
    ``build`` of what its folder holds, runs in append mode from the same checkpoint until all is processed. State and
    watermark go on from run to run. Returns all rows that were ever emitted, and the progress of every micro-batch that
    has a state operator: ``rows`` read, ``state_rows`` kept, ``late_groups`` dropped."""
    spark = arrivals[0].sparkSession
    folder, out, ckpt = (scratch_path(spark, f"{name}-{part}") for part in ("in", "out", "ckpt"))
    progress: list[dict] = []
    for frame in arrivals:
        frame.write.mode("append").parquet(folder)
        stream = build(spark.readStream.schema(frame.schema).parquet(folder))
        query = (stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
                 .format("parquet").option("path", out).outputMode("append").start())
        query.awaitTermination()
        if query.exception() is not None:
            raise RuntimeError(str(query.exception()))
        for p in query.recentProgress:
            for state in p.stateOperators:
                progress.append({"rows": p.numInputRows, "state_rows": state.numRowsTotal, "late_groups": state.numRowsDroppedByWatermark})
    return spark.read.schema(stream.schema).parquet(out), progress


def score_stream(stream: DataFrame, model, keep: list[str]) -> DataFrame:
    """Stateless scoring of a stream, score = p1 - p0."""
    from worthrank.operators.models import score

    return score(model, stream, keep)


def window_counts(stream: DataFrame, ts_col: str, key_col: str, positive: F.Column,
                  window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Tumbling event-time window counts per key. ``TIMESTAMP_NTZ`` input is cast to
    ``TIMESTAMP`` (watermarks need it); window bounds come back as wall-clock ``TIMESTAMP_NTZ``.
    Run it in ``append``/``update`` mode for a long-lived stream: the watermark then drops late
    rows and evicts closed windows; ``complete`` keeps every window's state."""
    s = stream.withColumn("_event_time", F.col(ts_col).cast("timestamp")).withWatermark("_event_time", watermark)
    agg = s.groupBy(F.window("_event_time", window).alias("w"), F.col(key_col)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(positive.cast("int")).cast("bigint").alias("n_positive"))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key_col, "n", "n_positive")


def linear_head_stream(stream: DataFrame, head_row, vec_col: str = "embedding", out: str = "z") -> DataFrame:
    """X1 with a linear head fitted in batch: its weights (one value per embedding dimension, so
    bounded by the vector width, not the data) travel to the stream as literals."""
    from worthrank.functions.scalar import linear

    w = F.array(*[F.lit(float(x)) for x in head_row["w"]])
    return stream.withColumn(out, linear(vec_col, w, F.lit(float(head_row["b"]))))
