"""Readers for the task's file formats (S1-S12), always with an explicit schema.

Two text dialects exist and must not be mixed up:

* ``quoted`` - what a CSV parser sees: a field starting with ``"`` is quoted, ``""`` is an
  escaped quote (Spark's default escape ``\\`` would silently corrupt such text);
* ``raw``    - what a plain ``line.split('\\t')`` sees: quotes are ordinary characters.

A document is one file; its id is the file name without extension (``doc_from='file'``), or the
``doc_id=...`` directory written by ``partitionBy`` (``doc_from='partition'``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worthrank.functions.scalar import strip
from worthrank.operators.ranking import rank_within
from worthrank.session import checkpoint_dir

TRANSCRIPT_SCHEMA = T.StructType([
    T.StructField("line_number", T.IntegerType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("statement", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

TWEET_ID = T.DecimalType(23, 0)  # 17-23 digit ids: wider than BIGINT

TWEET_SCHEMA = T.StructType([
    T.StructField("topic_id", T.StringType()),
    T.StructField("tweet_id", TWEET_ID),
    T.StructField("tweet_url", T.StringType()),
    T.StructField("tweet_text", T.StringType()),
    T.StructField("claim", T.IntegerType()),
    T.StructField("check_worthiness", T.IntegerType()),
])

DEBATE_SCHEMA = T.StructType([
    T.StructField("Sentence_id", T.LongType()),
    T.StructField("Text", T.StringType()),
    T.StructField("Speaker", T.StringType()),
    T.StructField("Speaker_title", T.StringType()),
    T.StructField("Speaker_party", T.StringType()),
    T.StructField("File_id", T.StringType()),
    T.StructField("Length", T.IntegerType()),
    T.StructField("Line_number", T.IntegerType()),
    T.StructField("Sentiment", T.DoubleType()),
    T.StructField("Verdict", T.IntegerType()),
])

ALL_SENTENCES_SCHEMA = T.StructType(
    [f for f in DEBATE_SCHEMA.fields if f.name != "Verdict"] + [T.StructField("Speaker_role", T.StringType())])

CURATED_SCHEMA = T.StructType([
    T.StructField("sentence_id", T.LongType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

PRED_2019_SCHEMA = T.StructType([
    T.StructField("line_number", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
])

PRED_2020_SCHEMA = T.StructType([
    T.StructField("topic_id", T.StringType()),
    T.StructField("tweet_id", TWEET_ID),
    T.StructField("score", T.DoubleType()),
    T.StructField("run_id", T.StringType()),
])


def split_paths(spec: str | Sequence[str]) -> list[str]:
    """A comma-separated path list (entries trimmed) or a list of paths."""
    if isinstance(spec, str):
        return [p.strip() for p in spec.split(",") if p.strip()]
    return [p.strip() for p in spec]


def _tsv(spark: SparkSession, schema: T.StructType, dialect: str, header: bool = False,
         multiline: bool = False, doc_from: str | None = None):
    r = spark.read.option("sep", "\t").option("header", header).option("mode", "PERMISSIVE")
    if dialect == "quoted":
        r = r.option("quote", '"').option("escape", '"')
    elif dialect == "raw":
        r = r.option("quote", "")
    else:
        raise ValueError("dialect is 'quoted' or 'raw'")
    if multiline:
        r = r.option("multiLine", True)
    if doc_from == "partition":
        schema = T.StructType(list(schema.fields) + [T.StructField("doc_id", T.StringType())])
    return r.schema(schema)


def _with_doc(df: DataFrame, doc_from: str) -> DataFrame:
    if doc_from == "file":
        name = F.col("_metadata.file_name")
        return df.withColumn("doc_id", F.regexp_replace(name, r"\.[^.]*$", ""))
    if doc_from == "partition":
        return df
    if doc_from == "none":
        return df
    raise ValueError("doc_from is 'file', 'partition' or 'none'")


def read_transcripts(spark: SparkSession, paths: str | Sequence[str], dialect: str = "quoted",
                     doc_from: str = "file", multiline: bool = False) -> DataFrame:
    """Headerless ``line_number, speaker, statement, label`` lines, one file per
    document. ``multiline=True`` allows newlines inside quoted statements (whole-file tasks)."""
    df = _tsv(spark, TRANSCRIPT_SCHEMA, dialect, multiline=multiline, doc_from=doc_from).csv(split_paths(paths))
    return _with_doc(df, doc_from)


def read_tweets(spark: SparkSession, paths: str | Sequence[str], multiline: bool = True) -> DataFrame:
    """S3: headered tweet TSV; ids as DECIMAL(23,0)."""
    return _tsv(spark, TWEET_SCHEMA, "quoted", header=True, multiline=multiline).csv(split_paths(paths))


def read_debate_sentences(spark: SparkSession, paths: str | Sequence[str], all_sentences: bool = False) -> DataFrame:
    """Headered comma-separated debate sentences (``all_sentences`` has no Verdict and
    adds Speaker_role)."""
    schema = ALL_SENTENCES_SCHEMA if all_sentences else DEBATE_SCHEMA
    return (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", True).csv(split_paths(paths)))


def read_corpus(spark: SparkSession, paths: str | Sequence[str], corpus: str, phase: str = "train") -> DataFrame:
    """The source of a corpus and phase. ``transcripts``: labelled lines, one file a document (S1). ``tweets``: headered posts
    (S3). ``debates``: sentences with a verdict for training and validation (S4), all sentences without one to be scored (S5).
    ``curated``: labelled sentences (S6), training and validation only."""
    if phase not in ("train", "val", "test"):
        raise ValueError(f"unknown phase {phase!r}")
    if corpus == "transcripts":
        return read_transcripts(spark, paths)
    if corpus == "tweets":
        return read_tweets(spark, paths)
    if corpus == "debates":
        return read_debate_sentences(spark, paths, all_sentences=phase == "test")
    if corpus == "curated" and phase != "test":
        return read_curated_json(spark, paths)
    raise ValueError(f"no {phase} source of corpus {corpus!r}")


def read_curated_json(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A JSON list of ``{sentence_id, label, text}`` objects per file."""
    return spark.read.schema(CURATED_SCHEMA).option("multiLine", True).json(split_paths(paths)).select(*CURATED_SCHEMA.names)


def read_predictions_2019(spark: SparkSession, paths: str | Sequence[str], doc_from: str = "file") -> DataFrame:
    """``line_number TAB score`` rankings, one file per document."""
    df = _tsv(spark, PRED_2019_SCHEMA, "raw", doc_from=doc_from).csv(split_paths(paths))
    return _with_doc(df, doc_from)


def read_predictions_2020(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``topic_id, tweet_id, score, run_id`` rankings."""
    return _tsv(spark, PRED_2020_SCHEMA, "raw").csv(split_paths(paths))


#: Splits of text files (about a hundred bytes each) up to which their line numbers are broadcast.
SPLITS_LIMIT = 2_000_000


def read_lines(spark: SparkSession, paths: str | Sequence[str], strategy: str = "offsets",
               doc_from: str = "file") -> DataFrame:
    """Raw lines with their 1-based position in the document: ``doc_id, path, pos, line``.

    A text file may be split over several tasks. ``offsets`` counts the lines of every split, adds up the counts along
    the splits of a document and gives each line the sum before its split plus its place in it: no line is sorted or
    shuffled, only the table of splits is, which is broadcast up to ``SPLITS_LIMIT`` of them. The lines are checkpointed
    once, so both reads see the same rows. Other strategies number the lines by a sort (``rank_within``).
    """
    raw = spark.read.text(split_paths(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("_name"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
        F.col("value").alias("line"))
    if doc_from in ("partition", "directory"):
        # a document is a directory (``doc_id=...`` or the output directory of one write) that may hold several part files;
        # those of a range-partitioned or sorted write are in line order by their part number
        pattern = r"/doc_id=([^/]+)/[^/]*$" if doc_from == "partition" else r"/([^/]+)/[^/]*$"
        raw = raw.withColumn("doc_id", F.regexp_extract("path", pattern, 1))
        groups, order = ["doc_id"], ["_part", "path", "_block"]
    else:
        raw = raw.withColumn("doc_id", F.regexp_replace("_name", r"\.[^.]*$", ""))
        groups, order = ["path"], ["_block"]
    raw = raw.withColumn("_part", F.regexp_extract("_name", r"^part-(\d+)", 1).try_cast("bigint")).drop("_name")
    if strategy != "offsets":
        numbered = rank_within(raw, groups, [*order, "_seq"], strategy=strategy)
        return numbered.select("doc_id", "path", F.col("row_number").alias("pos"), "line")
    checkpoint_dir(spark)
    held = raw.checkpoint(eager=True)
    splits = held.groupBy("doc_id", "path", "_part", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    before = Window.partitionBy(*groups).orderBy(*[F.asc_nulls_first(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("path", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset")).checkpoint(eager=True)
    if offsets.count() <= SPLITS_LIMIT:
        offsets = F.broadcast(offsets)
    return held.join(offsets, ["path", "_block"]).select("doc_id", "path", (F.col("_seq") + F.col("_offset")).alias("pos"), "line")


def parse_gold_2019(lines: DataFrame) -> DataFrame:
    """Raw split of stripped lines into exactly 4 fields; ``n_fields`` is kept so a wrong count
    becomes a violation rather than an exception."""
    f = F.split(strip("line"), "\t")
    return lines.select("doc_id", "pos", F.size(f).alias("n_fields"),
                        strip(F.get(f, 0)).try_cast("int").alias("line_number"),
                        strip(F.get(f, 3)).try_cast("int").alias("label"))


def parse_gold_2020(lines: DataFrame) -> DataFrame:
    """Raw split into 6 fields, the header row skipped by value."""
    f = F.split(strip("line"), "\t")
    return (lines.select("doc_id", "pos", F.size(f).alias("n_fields"), F.get(f, 0).alias("topic_id"),
                         strip(F.get(f, 1)).try_cast(TWEET_ID).alias("tweet_id"),
                         strip(F.get(f, 5)).try_cast("int").alias("label"))
            .filter(F.col("topic_id").isNull() | (F.col("topic_id") != "topic_id")))


def parse_predictions_2019(lines: DataFrame) -> DataFrame:
    """S9 with the line position kept (ties keep file order): ``doc_id, pos, line_number, score,
    n_fields`` from raw lines."""
    f = F.split(strip("line"), "\t")
    return lines.select("doc_id", "pos", strip(F.get(f, 0)).try_cast("int").alias("line_number"),
                        strip(F.get(f, 1)).try_cast("double").alias("score"), F.size(f).alias("n_fields"))


def parse_predictions_2020(lines: DataFrame) -> DataFrame:
    """S10 with the line position kept: in 2020 rankings equal scores keep physical file order,
    which a CSV read does not guarantee across splits. ``doc_id, pos, topic_id, tweet_id, score,
    run_id, n_fields`` from raw lines."""
    f = F.split(strip("line"), "\t")
    return lines.select("doc_id", "pos", F.get(f, 0).alias("topic_id"),
                        strip(F.get(f, 1)).try_cast(TWEET_ID).alias("tweet_id"),
                        strip(F.get(f, 2)).try_cast("double").alias("score"),
                        strip(F.get(f, 3)).alias("run_id"), F.size(f).alias("n_fields"))
