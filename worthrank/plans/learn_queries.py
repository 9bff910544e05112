"""Registered model and streaming queries.

Fitted-model outputs depend on the optimiser and have no SQL equivalent: those queries are
checked by row count only (and by the unit tests). The windowed stream counts are SQL-checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from worthrank.functions.scalar import lcg_key
from worthrank.operators.metrics import ranking_metrics
from worthrank.operators.models import (corpus_weights, embedding_features, fit_persisted, frozen_head,
                                        load_model, ngram_pipeline, score, select_best, with_weights)
from worthrank.operators.prepare import exact_split
from worthrank.plans.prepare_queries import LCG_SQL
from worthrank.plans.registry import register, round6
from worthrank.session import scratch_path
from worthrank.sinks.writers import save_model
from worthrank.sources.testdata import table
from worthrank.streaming.scoring import (linear_head_stream, read_table_stream, run_arrivals, run_to_files,
                                        score_stream, window_counts)


def labelled_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return d.join(lab, "doc_id").withColumn("label", F.when(F.col("label") == 1, 1).otherwise(0))


def fit_ngram_baseline(spark, sf_dir):
    """M2 + T1 + A2: fit the n-gram baseline on the training split with class weights. Returns the model and
    the labelled texts with their split."""
    split = exact_split(labelled_texts(spark, sf_dir), "doc_id", 0.2, key=lcg_key)
    train = with_weights(split.filter(F.col("split") == "train"), "label")
    return fit_persisted(ngram_pipeline(), train), split


@register("ngram_baseline", None,
          "M2 M4 T1 A2 A9: hashed word n-grams + IDF + class-weighted logistic regression, "
          "evaluated per topic on the rows it wasn't trained on (rows only)")
def q_ngram_baseline(spark, sf_dir):
    model, g = fit_ngram_baseline(spark, sf_dir)
    scored = score(model, g.filter(F.col("split") == "val"), ["source", "doc_id", "label"])
    per = ranking_metrics(scored.withColumnRenamed("source", "topic_id"), ["topic_id"], tie_cols=("doc_id",))
    return round6(per)


def score_checks(scored, again=None):
    """What holds for every scored row: the score lies in [-1, 1], the prediction is its sign, and a second
    scoring (``again``, same key) gives the same."""
    key = scored.columns[0]
    out = scored.withColumn("in_range", F.col("score").between(-1.0, 1.0))
    out = out.withColumn("consistent", (F.col("score") > 0) == (F.col("prediction") == 1))
    if again is not None:
        other = again.select(F.col(key), F.col("score").alias("_again"))
        out = out.join(other, key, "left").withColumn("same_when_loaded", F.abs(F.col("score") - F.col("_again")) < 1e-12).drop("_again")
    return out.drop("score", "prediction")


END_MARK = "end of the stream"
VAL_SQL = """SELECT {cols}, row_number() OVER (ORDER BY {key}, {id}) AS k, COUNT(*) OVER () AS n FROM {source}"""


@register("ngram_model_checks", f"""
WITH g AS (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS label FROM documents d JOIN labels l USING (doc_id)),
s AS ({VAL_SQL.format(cols="doc_id, label", key=LCG_SQL.format(x="doc_id"), id="doc_id", source="g")})
SELECT doc_id, label, TRUE AS in_range, TRUE AS consistent, TRUE AS same_when_loaded FROM s WHERE k <= CEIL(0.2 * n)""",
          "M2 M4 K5 S13 T1: the held-out rows, one score each, in range, agreeing with the prediction, and "
          "equal when the saved model is loaded again")
def q_ngram_model_checks(spark, sf_dir):
    model, g = fit_ngram_baseline(spark, sf_dir)
    loaded = load_model(save_model(model, scratch_path(spark, "ngram-model")))
    val = g.filter(F.col("split") == "val")
    return score_checks(score(model, val, ["doc_id", "label"]), score(loaded, val, ["doc_id"]))


def fit_frozen_head(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("label") == 1, 1).otherwise(0))
    e = embedding_features(exact_split(e, "vec_id", 0.2, key=lcg_key))
    train = with_weights(e.filter(F.col("split") == "train"), "label")
    val = e.filter(F.col("split") == "val")
    best, _ = select_best(train, val, [{"reg": 0.0}, {"reg": 0.01}, {"reg": 0.1}],
                          lambda reg: frozen_head(reg=reg), ["vec_id"])
    return best, e


@register("frozen_head_train_score", None,
          "M3 M4 M5 T7 A10 A15: linear head over supplied embeddings, candidates chosen by "
          "validation accuracy (ties to the first), all rows scored (rows only)")
def q_frozen_head(spark, sf_dir):
    best, e = fit_frozen_head(spark, sf_dir)
    return round6(score(best, e, ["vec_id", "split", "label"]))


@register("frozen_head_checks", f"""
WITH e AS (SELECT vec_id, CASE WHEN label = 1 THEN 1 ELSE 0 END AS label FROM embeddings),
s AS ({VAL_SQL.format(cols="vec_id, label", key=LCG_SQL.format(x="vec_id"), id="vec_id", source="e")})
SELECT vec_id, CASE WHEN k <= CEIL(0.2 * n) THEN 'val' ELSE 'train' END AS split, label, TRUE AS in_range, TRUE AS consistent FROM s""",
          "M3 M4 M5 T1: every row scored once, with its split, in range and agreeing with the prediction")
def q_frozen_head_checks(spark, sf_dir):
    best, e = fit_frozen_head(spark, sf_dir)
    return score_checks(score(best, e, ["vec_id", "split", "label"]))


@register("staged_training", None,
          "M6 U2: corpora (languages) combined with per-corpus weights times class weights, "
          "one weighted fit on the training split, all rows scored (rows only)")
def q_staged_training(spark, sf_dir):
    g = exact_split(corpus_weights(labelled_texts(spark, sf_dir), "lang", {"en": 1.0}, default=0.5), "doc_id", 0.2, key=lcg_key)
    train = with_weights(g.filter(F.col("split") == "train"), "label", extra="corpus_weight")
    model = fit_persisted(ngram_pipeline(), train)
    return round6(score(model, g, ["doc_id", "lang", "label", "split"]))


@register("stream_score", None,
          "X1: a fitted model scoring the documents table read as a stream (file sink, rows only)")
def q_stream_score(spark, sf_dir):
    model, _ = fit_ngram_baseline(spark, sf_dir)
    # the text-heavy feature stages run in as many tasks as a shuffle has, not one per file of a micro-batch
    stream = read_table_stream(spark, sf_dir, "documents").select("doc_id", "source", "text").repartition("doc_id")
    out = run_to_files(score_stream(stream, model, ["doc_id", "source"]), "stream-score", "append")
    return spark.read.parquet(out)


@register("stream_window_counts", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
       COUNT(*) AS n, CAST(SUM(CASE WHEN value > 250 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive
FROM events GROUP BY 1, 2""",
          "X2: hourly event-time windows per event type with a watermark (stream, complete mode)")
def q_stream_window_counts(spark, sf_dir):
    stream = read_table_stream(spark, sf_dir, "events")
    counts = window_counts(stream, "ts", "event_type", F.col("value") > 250)
    out = run_to_files(counts, "stream-window", "complete")
    back = spark.read.parquet(out)
    return back.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                       "event_type", "n", "n_positive")


@register("stream_late_rows", """
WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
q AS (SELECT e.*, CAST(floor(4.0 * (epoch_us(ts) - lo) / (hi - lo + 1)) AS INTEGER) AS part FROM events e, b),
a AS (SELECT *, part <= 1 AND event_id % 10 = 3 AS delayed, date_trunc('hour', ts) AS w FROM q),
m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM a WHERE part <= 1 AND NOT delayed),
d AS (SELECT a.*, delayed AND w + INTERVAL 1 HOUR <= mark AS late FROM a, m)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, COUNT(*) AS n,
       CAST(SUM(CASE WHEN value > 250 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive FROM d WHERE NOT late GROUP BY 1, 2
UNION ALL
SELECT '', 'dropped as late', COUNT(*), 0 FROM d WHERE late""",
          "X2: append mode over several arrivals, one of them delayed: closed windows are emitted once, rows "
          "behind the watermark are dropped and counted")
def q_stream_late_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = e.select(F.min(micros), F.max(micros)).first()
    part = F.floor(F.lit(4.0) * (micros - F.lit(lo)) / F.lit(hi - lo + 1)).cast("int")
    delayed = (part <= 1) & (F.col("event_id") % 10 == 3)
    arrivals = [e.where((part == k) & ~delayed) for k in range(4)]
    arrivals.insert(2, e.where(delayed))
    # the end of the stream: a row so far ahead that every other window closes
    end = e.limit(1).select("event_id", F.lit(END_MARK).alias("event_type"), "value", F.timestamp_micros(F.lit(hi + 86_400_000_000)).cast(e.schema["ts"].dataType).alias("ts"))
    counts, progress = run_arrivals([*arrivals, end], lambda s: window_counts(s, "ts", "event_type", F.col("value") > 250), "late")
    counts = counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "n_positive")
    late = e.agg(F.count(F.lit(1)).alias("n")).select(F.lit("").alias("window_start"), F.lit("dropped as late").alias("event_type"),
                                                      (F.col("n") - counts.select(F.sum("n")).scalar()).alias("n"), F.lit(0).cast("bigint").alias("n_positive"))
    return counts.unionByName(late)


@register("stream_linear_head_score", """
WITH e AS (SELECT vec_id, label, CASE WHEN label = 1 THEN 1 ELSE 0 END AS cls, embedding FROM embeddings),
x AS (SELECT vec_id, label, cls, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS dim FROM e),
c AS (SELECT dim, AVG(CASE WHEN cls = 1 THEN CAST(v AS DOUBLE) END) AS m1,
             AVG(CASE WHEN cls = 0 THEN CAST(v AS DOUBLE) END) AS m0 FROM x GROUP BY dim),
w AS (SELECT dim, m1 - m0 AS w, (m1 + m0) / 2 AS mid FROM c),
b AS (SELECT -SUM(w * mid) AS b FROM w),
z AS (SELECT x.vec_id, x.cls, SUM(CAST(x.v AS DOUBLE) * w.w) AS dotp FROM x JOIN w ON x.dim = w.dim
      GROUP BY x.vec_id, x.cls)
SELECT vec_id, cls AS label, ROUND(dotp + (SELECT b FROM b), 6) AS z,
       CASE WHEN dotp + (SELECT b FROM b) > 0 THEN 1 ELSE 0 END AS prediction
FROM z""", "X1 F9 T7: a linear head fitted in batch (class centroids) scoring the embeddings read as a "
          "stream (file sink)")
def q_stream_linear_head_score(spark, sf_dir):
    from worthrank.functions.scalar import binarize
    from worthrank.operators.encode import centroid_head

    head = centroid_head(table(spark, sf_dir, "embeddings"), "label").first()  # one row: w[dim], b
    stream = read_table_stream(spark, sf_dir, "embeddings")
    scored = linear_head_stream(stream, head).select("vec_id", binarize("label").alias("label"), "z")
    out = run_to_files(scored, "stream-head", "append")
    back = spark.read.parquet(out)
    return round6(back.withColumn("prediction", F.when(F.col("z") > 0, 1).otherwise(0)))
