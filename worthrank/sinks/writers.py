"""Sinks (K1-K7): ranking files, per-document split output, model save, run log, metric report.

Writers carry ``doc_id`` and use ``partitionBy``: every document's rows land under
``doc_id=<id>/`` in parallel, instead of re-cutting one big file by row order on a single machine.
Before a per-document write the rows are range-partitioned on (document, line): each task holds a
contiguous key range, so the number of files stays at most documents + tasks (not tasks x
documents), and a very large document is spread over several tasks instead of one.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worthrank.session import tasks_for
from worthrank.functions.scalar import DEFAULT_RUN_ID, SCORE_DECIMALS, SPLIT_SUFFIX, fixed, hms, round_half_even

RUN_LOG_SCHEMA = T.StructType([
    T.StructField("run_ts", T.TimestampType()),
    T.StructField("phase", T.StringType()),
    T.StructField("settings", T.MapType(T.StringType(), T.StringType())),
    T.StructField("stats", T.MapType(T.StringType(), T.StringType())),
])


def _write_partitions(df: DataFrame) -> int:
    """Tasks for a per-document write, by the number of lines and one per core at least, given explicitly so
    AQE does not merge the range partitions by byte size - writing many small per-document files is
    bound by files per task, not by bytes."""
    return tasks_for(df)


def score_text(col: str = "score") -> "F.Column":
    """Scores as written: rounded half-to-even to 5 decimals, ``%.5f``."""
    return fixed(round_half_even(col, SCORE_DECIMALS), SCORE_DECIMALS)


def write_ranking_2019(df: DataFrame, path: str, id_col: str = "line_number", score_col: str = "score",
                       doc_col: str = "doc_id", mode: str = "overwrite") -> None:
    """K1 + K4: ``id TAB score`` lines, no header, one directory per document."""
    (df.repartitionByRange(_write_partitions(df), doc_col, id_col)
     .select(doc_col, F.col(id_col).cast("string").alias("id"), score_text(score_col).alias("score"))
     .write.mode(mode).partitionBy(doc_col).option("sep", "\t").option("quote", "").csv(path))


def write_ranking_2020(df: DataFrame, path: str, run_id: str = DEFAULT_RUN_ID, mode: str = "overwrite") -> None:
    """K2: ``topic_id TAB tweet_id TAB score TAB run_id`` lines with a constant run id."""
    (df.select("topic_id", F.col("tweet_id").cast("string"), score_text("score").alias("score"),
               F.lit(run_id).alias("run_id"))
     .write.mode(mode).option("sep", "\t").option("quote", "").csv(path))


def write_ranking(df: DataFrame, path: str, corpus: str, **kw) -> str | None:
    """P8 + K3: choose the ranking format by corpus: transcripts (line number, score), tweets (topic, id, score, run id); the debate-sentence corpus writes none."""
    if corpus == "transcripts":
        write_ranking_2019(df, path, **kw)
        return path
    if corpus == "tweets":
        write_ranking_2020(df, path, **kw)
        return path
    if corpus == "debates":
        return None
    raise ValueError(f"unknown corpus {corpus!r}")


def write_transcripts(df: DataFrame, path: str, doc_col: str = "doc_id", mode: str = "overwrite") -> None:
    """Transcript lines in the quoted dialect (statements with tabs, quotes or newlines are
    quoted, quotes doubled), one directory per document."""
    (df.repartitionByRange(_write_partitions(df), doc_col, "line_number")
     .select(doc_col, "line_number", "speaker", "statement", "label")
     .write.mode(mode).partitionBy(doc_col).option("sep", "\t").option("quote", '"').option("escape", '"')
     .csv(path))


def write_tweets(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headered tweet TSV in the quoted dialect."""
    (df.select("topic_id", F.col("tweet_id").cast("string").alias("tweet_id"), "tweet_url", "tweet_text",
               "claim", "check_worthiness")
     .write.mode(mode).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"')
     .csv(path))


def write_debate_sentences(df: DataFrame, path: str, mode: str = "overwrite", all_sentences: bool = False) -> None:
    """Headered comma-separated debate sentences in the quoted dialect (the S4 layout; S5 with ``all_sentences``)."""
    cols = ["Sentence_id", "Text", "Speaker", "Speaker_title", "Speaker_party", "File_id", "Length",
            "Line_number", "Sentiment", "Speaker_role" if all_sentences else "Verdict"]
    (df.select(*cols).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .csv(path))


def write_curated_json(df: DataFrame, path: str, rows_per_file: int = 1000, mode: str = "overwrite") -> None:
    """The S6 layout: files that hold one JSON list of ``{sentence_id, label, text}`` objects each, of about ``rows_per_file``."""
    files = max(1, -(-df.count() // rows_per_file))
    row = F.struct("sentence_id", "label", "text")
    lists = df.groupBy(F.pmod(F.xxhash64(row), F.lit(files)).alias("list")).agg(F.to_json(F.collect_list(row)).alias("value"))
    lists.write.mode(mode).partitionBy("list").text(path)


def save_model(model, path: str) -> str:
    """K5: persist a fitted MLlib model, replacing the previous best."""
    model.write().overwrite().save(path)
    return path


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and a function from text to its paths."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


def _move(fs, source, target) -> bool:
    """Rename to a name that isn't there yet. False if it is (or comes up meanwhile)."""
    fs.mkdirs(target.getParent())
    return not fs.exists(target) and bool(fs.rename(source, target))


def append_runs(records: DataFrame, path: str, append_id: str | None = None) -> bool:
    """K6: append records of RUN_LOG_SCHEMA to the log. They are written beside the log and renamed into it as a folder of their
    own, so readers see all of an append or nothing, and appends at the same time don't touch each other's files. An
    ``append_id`` that is already in the log is not appended again (False), which makes retries safe."""
    spark = records.sparkSession
    fs, of = _files(spark, path)
    name = append_id or uuid.uuid4().hex
    target, staging = of(f"{path}/append={name}"), f"{path}/_staging-{name}-{uuid.uuid4().hex}"
    if fs.exists(target):
        return False
    records.select(*[f.name for f in RUN_LOG_SCHEMA.fields]).write.parquet(staging)
    if _move(fs, of(staging), target):
        return True
    fs.delete(of(staging), True)
    return False


def append_run_log(spark: SparkSession, path: str, phase: str, settings: Mapping[str, object],
                   stats: Mapping[str, object], run_ts: _dt.datetime | None = None) -> None:
    """K6: append one run record ``(run_ts, phase, settings, stats)`` to the log."""
    row = (run_ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), phase,
           {str(k): str(v) for k, v in settings.items()}, {str(k): str(v) for k, v in stats.items()})
    append_runs(spark.createDataFrame([row], RUN_LOG_SCHEMA).coalesce(1), path)


def read_run_log(spark: SparkSession, path: str, newest: int | None = None, ties: Sequence[str | Column] = ()) -> DataFrame:
    """K6 + L5: the run log, newest record first (equal times by ``ties``, descending), with elapsed time as ``h:mm:ss`` when
    the stats hold ``elapsed_seconds``. With ``newest`` only so many records, by a top-k in every task: nothing
    but these is sorted."""
    log = spark.read.schema(RUN_LOG_SCHEMA).parquet(path)
    secs = F.col("stats")["elapsed_seconds"].try_cast("double")
    out = log.withColumn("elapsed", hms(secs)).orderBy(F.desc("run_ts"), *[F.desc(t) if isinstance(t, str) else t.desc() for t in ties])
    return out if newest is None else out.limit(newest)


def write_named_rankings(df: DataFrame, path: str, id_col: str = "line_number", score_col: str = "score", doc_col: str = "doc_id") -> list[str]:
    """K1 + K4: one file ``<document>_out.tsv`` of ``id TAB score`` lines for each document, in the order of the ids. Returns the file names.

    First all documents are written to a staging folder, each by one task that streams its sorted lines (a file has
    one writer; what one holds is a sort buffer that spills). Then every file is renamed. A call that finds a staging
    folder whose write was finished, by a driver that died between the two, goes on with the renames and writes nothing."""
    spark = df.sparkSession
    fs, of = _files(spark, path)
    staging = f"{path}/_staging"
    if not fs.exists(of(f"{staging}/_SUCCESS")):
        lines = df.select(doc_col, F.col(id_col).alias("_id"), F.col(id_col).cast("string").alias("id"), score_text(score_col).alias("score"))
        lines = lines.repartition(_write_partitions(df), doc_col).sortWithinPartitions(doc_col, "_id").drop("_id")
        lines.write.mode("overwrite").partitionBy(doc_col).option("sep", "\t").option("quote", "").csv(staging)
    for folder in fs.listStatus(of(staging)):
        if folder.isDirectory():
            doc = unquote(folder.getPath().getName().split("=", 1)[1])
            for part in fs.listStatus(folder.getPath()):
                target = of(f"{path}/{doc.removesuffix('.tsv')}{SPLIT_SUFFIX}")
                if not _move(fs, part.getPath(), target):
                    fs.delete(target, False)
                    fs.rename(part.getPath(), target)
    fs.delete(of(staging), True)
    return sorted(f.getPath().getName() for f in fs.listStatus(of(path)) if f.getPath().getName().endswith(SPLIT_SUFFIX))


def metric_report(per_doc: DataFrame, means: DataFrame, metric_cols: Sequence[str],
                  doc_col: str = "doc_id") -> DataFrame:
    """K7: per-document rows then the averaged row, values as 4-decimal text (rounded half to
    even on the exact binary value, like Python's ``'{:.4f}'``)."""
    docs = per_doc.select(F.col(doc_col).cast("string").alias("doc_id"),
                          *[F.format_number(F.col(c), 4).alias(c) for c in metric_cols])
    mean_map = {"ap": "map", "rr": "mrr", "r_prec": "mean_r_prec"}
    avg = means.select(F.lit("AVERAGED").alias("doc_id"),
                       *[F.format_number(F.col(mean_map.get(c, f"mean_{c}")), 4).alias(c)
                         for c in metric_cols])
    return docs.unionByName(avg)
