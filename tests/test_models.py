"""MLlib model operators, the pandas scorer hook, and the streaming extensions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from worthrank.operators.models import (corpus_weights, embedding_features, frozen_head, ngram_pipeline, random_scores,
                                        score, score_with_pandas, select_best, training_loss, with_weights)
from worthrank.plans import REGISTRY
from worthrank.plans.learn_queries import fit_ngram_baseline
from worthrank.streaming.scoring import read_table_stream, run_to_files, window_counts

SF = "/root/testdata/sf0.001"


def _texts(spark):
    rows = [(i, ("claim tax percent million" if i % 3 == 0 else "hello thank you everyone"), int(i % 3 == 0))
            for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_ngram_pipeline_separates_and_scores_in_range(spark):
    df = with_weights(_texts(spark), "label")
    model = ngram_pipeline(num_features=1 << 10, max_iter=30).fit(df)
    out = score(model, df, ["doc_id", "label"]).collect()
    assert all(-1.0 <= r["score"] <= 1.0 for r in out)
    assert all((r["score"] > 0) == (r["label"] == 1) for r in out)
    hist = training_loss(model).collect()
    assert len(hist) >= 2 and hist[-1]["loss"] <= hist[0]["loss"]
    assert hist[1]["mean_loss"] == pytest.approx((hist[0]["loss"] + hist[1]["loss"]) / 2)


def test_frozen_head_and_candidate_selection(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn(
        "label", F.when(F.col("label") == 1, 1).otherwise(0))
    e = embedding_features(e)
    train = with_weights(e, "label")
    best, table = select_best(train, e, [{"reg": 0.5}, {"reg": 0.5}], lambda reg: frozen_head(reg=reg), ["vec_id"])
    rows = table.orderBy("candidate").collect()
    assert rows[0]["val_acc"] == rows[1]["val_acc"]  # identical candidates tie ...
    assert best is not None                        # ... and the first one is kept
    scored = score(best, e, ["vec_id"]).collect()
    assert len(scored) == e.count()


def test_random_scores_and_pandas_scorer(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    r = random_scores(df, "doc_id").agg(F.min("score"), F.max("score"), F.countDistinct("score")).first()
    assert 0.0 <= r[0] and r[1] < 1.0 and r[2] == 1000
    out = score_with_pandas(df, lambda pdf: pd.Series(pdf["doc_id"] * 0.5), ["doc_id"])
    assert out.agg(F.sum("score")).first()[0] == pytest.approx(0.5 * sum(range(1000)))


def test_corpus_weights(spark):
    df = spark.createDataFrame([("en",), ("de",)], "lang string")
    got = {r["lang"]: r["corpus_weight"] for r in corpus_weights(df, "lang", {"en": 1.0}, 0.5).collect()}
    assert got == {"en": 1.0, "de": 0.5}


def test_stream_window_counts_match_batch(spark):
    stream = read_table_stream(spark, SF, "events")
    out = run_to_files(window_counts(stream, "ts", "event_type", F.col("value") > 250), "test-window", "complete")
    got = spark.read.parquet(out)
    batch = (spark.read.parquet(f"{SF}/events.parquet")
             .groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type").count())
    assert got.count() == batch.count()
    assert got.agg(F.sum("n")).first()[0] == 1000


def test_a_stream_reads_a_table_of_several_files(spark, tmp_path):
    """A table is a file or a folder of part files; other tables' files in the same directory take no part."""
    rows = [(i, [float(i), 1.0 - i], i % 3 - 1) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    table.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    table.limit(7).toPandas().to_parquet(tmp_path / "events.parquet")
    for name, n in (("embeddings", 40), ("events", 7)):
        out = run_to_files(read_table_stream(spark, str(tmp_path), name).select("vec_id"), f"test-parts-{name}")
        assert sorted(r.vec_id for r in spark.read.parquet(out).collect()) == list(range(n))
    got = {r.vec_id: r for r in REGISTRY["stream_linear_head_score"].run(spark, str(tmp_path)).collect()}
    m1, m0 = (np.mean([v for _, v, y in rows if (y == 1) == one], axis=0) for one in (True, False))
    z = {i: float(np.dot(v, m1 - m0) - np.dot(m1 - m0, (m1 + m0) / 2)) for i, v, _ in rows}
    assert {i: (r.label, r.z) for i, r in got.items()} == {i: (int(y == 1), pytest.approx(z[i], abs=1e-5)) for i, _, y in rows}
    assert all(r.prediction == int(r.z > 0) for r in got.values())


def test_stream_score_scores_a_table_of_several_files_as_a_batch_does(spark, tmp_path):
    texts = ["claim tax percent million", "hello thank you everyone", "", "tax hello"]
    docs = [(i, f"s{i % 2}", "en", texts[i % 4]) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(50)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in REGISTRY["stream_score"].run(spark, str(tmp_path)).collect()}
    model, _ = fit_ngram_baseline(spark, str(tmp_path))
    batch = {r.doc_id: r for r in score(model, spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id", "source"]).collect()}
    assert len(got) == 60 and all((r.source, r.prediction) == (batch[i].source, batch[i].prediction) and r.score == pytest.approx(batch[i].score, abs=1e-6) for i, r in got.items())


def test_stream_score_scores_null_texts_as_empty_ones(spark, tmp_path):
    """Rows without text, in the training rows or not, are scored like empty texts; null sources and labels fail nothing."""
    texts = ["claim tax percent million", "hello thank you everyone", None, "tax hello", ""]
    docs = [(i, None if i % 7 == 0 else "s", "en", texts[i % 5]) for i in range(80)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, None if i % 11 == 0 else int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in REGISTRY["stream_score"].run(spark, str(tmp_path)).collect()}
    assert {i: r.source for i, r in got.items()} == {i: source for i, source, _, _ in docs}
    assert all(-1.0 <= r.score <= 1.0 and r.prediction == int(r.score > 0) for r in got.values())
    assert len({got[i].score for i in range(80) if not texts[i % 5]}) == 1 and got[0].score > got[1].score


def test_stream_score_reads_a_single_file_beside_other_layouts(spark, tmp_path):
    """A table that is one file, in a directory where another table is partitioned and a folder holds a file of the same name."""
    docs = pd.DataFrame({"doc_id": range(30), "source": "s", "lang": "en", "text": ["claim tax", "hello you", "tax you"] * 10})
    docs.to_parquet(tmp_path / "documents.parquet")
    (tmp_path / "older").mkdir()
    docs.to_parquet(tmp_path / "older" / "documents.parquet")
    pd.DataFrame({"doc_id": range(30), "quality": [1, 0, 0] * 10}).to_parquet(tmp_path / "labels.parquet")
    spark.range(9).withColumn("k", F.col("id") % 3).write.partitionBy("k").parquet(f"{tmp_path}/events.parquet")
    got = REGISTRY["stream_score"].run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "source", "score", "prediction"]
    assert sorted(r.doc_id for r in got.collect()) == list(range(30))


def test_watermark_drops_late_rows_in_append_mode(spark):
    """In append mode a row arriving after its window was closed by the watermark is dropped,
    and a window still open at the end of the input is held back."""
    import datetime as dt
    import os
    import tempfile
    import time

    src = tempfile.mkdtemp(prefix="worthrank-stream-")
    base = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, name))
        time.sleep(1.1)  # file order = micro-batch order

    t = lambda h, m: base + dt.timedelta(hours=h, minutes=m)
    put("a", [(i, t(h, 30), "view", 1.0) for i, h in enumerate(range(6))])   # batch 0: watermark becomes 04:30
    put("b", [(50, t(5, 45), "view", 1.0)])                                    # batch 1: closes 00:00-04:00 windows
    put("c", [(100, t(1, 5), "view", 1.0), (101, t(10, 5), "view", 1.0)])     # batch 2: 01:05 is late
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(src))
    out = run_to_files(window_counts(stream, "ts", "event_type", F.col("value") > 0), "test-late", "append")
    got = {r["window_start"].hour: r["n"] for r in spark.read.parquet(out).collect()}
    assert got.get(1) == 1      # the late row did not reopen the closed 01:00 window
    assert 10 not in got        # the last window is still open when the input ends
