"""Readers and writers on small files written to a fresh scratch directory."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from worthrank.functions.scalar import hms, split_file_name, word_count
from worthrank.sinks.writers import append_run_log, read_run_log, write_ranking, write_ranking_2019
from worthrank.sources.readers import (parse_gold_2019, parse_gold_2020, read_lines, read_predictions_2019,
                                       read_transcripts, split_paths)


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="worthrank-test-")


def _write(path, text, newline="\n"):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text.replace("\n", newline))


def test_quoted_and_raw_dialects(spark, scratch):
    content = '1\tA\t"Quoted ""start"" here"\t0\n2\tB\tplain "inner" quotes\t1\n3\tA\tNA\t0'
    _write(os.path.join(scratch, "20181015_debate.tsv"), content, newline="\r\n")
    quoted = read_transcripts(spark, os.path.join(scratch, "*.tsv"), dialect="quoted")
    rows = sorted((r["line_number"], r["statement"], r["label"], r["doc_id"]) for r in quoted.collect())
    assert rows[0] == (1, 'Quoted "start" here', 0, "20181015_debate")
    assert rows[1][1] == 'plain "inner" quotes' and rows[2][1] == "NA"
    raw = read_transcripts(spark, os.path.join(scratch, "*.tsv"), dialect="raw")
    assert sorted(r["statement"] for r in raw.collect())[0] == '"Quoted ""start"" here"'


def test_read_lines_keeps_file_order_across_splits(spark, scratch):
    n = 20000
    _write(os.path.join(scratch, "big.tsv"), "\n".join(f"{i}\t0.5" for i in range(1, n + 1)))
    _write(os.path.join(scratch, "small.tsv"), "1\t0.1\n2\t0.2")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        for strategy in ("window", "two_level"):
            lines = read_lines(spark, os.path.join(scratch, "*.tsv"), strategy=strategy)
            bad = lines.filter(F.split("line", "\t")[0].cast("long") != F.col("pos")).count()
            assert bad == 0 and lines.count() == n + 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_gold_parsers(spark, scratch):
    _write(os.path.join(scratch, "g19.tsv"), "1\tA\tx\t0\n2\tB\ty\t1\n3\tB\tbroken")
    g = parse_gold_2019(read_lines(spark, os.path.join(scratch, "g19.tsv")))
    got = sorted((r["line_number"], r["label"], r["n_fields"]) for r in g.collect())
    assert got == [(1, 0, 4), (2, 1, 4), (3, None, 3)]
    _write(os.path.join(scratch, "g20.tsv"),
           "topic_id\ttweet_id\ttweet_url\ttweet_text\tclaim\tcheck_worthiness\n"
           "covid\t1237160250513522688\thttp://t\ttext\t1\t1")
    g20 = parse_gold_2020(read_lines(spark, os.path.join(scratch, "g20.tsv"))).collect()
    assert len(g20) == 1 and str(g20[0]["tweet_id"]) == "1237160250513522688" and g20[0]["label"] == 1


def test_ranking_write_read_split(spark, scratch):
    df = spark.createDataFrame([("d1", 1, 0.123456), ("d1", 2, 5e-6), ("d2", 1, -0.5)],
                               "doc_id string, line_number int, score double")
    out = os.path.join(scratch, "ranks")
    write_ranking_2019(df, out)
    lines = sorted(r["value"] for r in spark.read.text(os.path.join(out, "doc_id=d1")).collect())
    assert lines == ["1\t0.12346", "2\t0.00000"]  # half-even: 5e-6 -> 0.00000
    back = read_predictions_2019(spark, out, doc_from="partition")
    assert back.count() == 3
    assert write_ranking(df, os.path.join(scratch, "cb"), "debates") is None


def test_run_log_and_formats(spark, scratch):
    log = os.path.join(scratch, "log")
    append_run_log(spark, log, "train", {"epochs": 3}, {"elapsed_seconds": 3725.4},
                   run_ts=dt.datetime(2024, 1, 1, 10))
    append_run_log(spark, log, "test", {}, {"elapsed_seconds": 90000}, run_ts=dt.datetime(2024, 1, 2, 10))
    rows = read_run_log(spark, log).collect()
    assert [r["phase"] for r in rows] == ["test", "train"]
    assert [r["elapsed"] for r in rows] == ["1 day, 1:00:00", "1:02:05"]
    df = spark.createDataFrame([(6.5, "  two  words\n", "data/x/20181015_60_min.tsv")], "s double, t string, p string")
    r = df.select(hms("s").alias("h"), word_count("t").alias("w"), split_file_name("p").alias("f")).first()
    assert (r["h"], r["w"], r["f"]) == ("0:00:06", 2, "20181015_60_min_out.tsv")
    assert split_paths(" a.tsv , b.tsv,") == ["a.tsv", "b.tsv"]


def test_debate_and_curated_readers(spark, scratch):
    from worthrank.sources.readers import read_curated_json, read_debate_sentences

    _write(os.path.join(scratch, "crowd.csv"),
           'Sentence_id,Text,Speaker,Speaker_title,Speaker_party,File_id,Length,Line_number,Sentiment,Verdict\n'
           '1,"We cut taxes, ""big"" time",A,Senator,R,f1,5,1,0.2,1\n'
           '2,Thank you,B,Governor,D,f1,2,2,-0.1,-1\n')
    d = read_debate_sentences(spark, os.path.join(scratch, "crowd.csv")).orderBy("Sentence_id").collect()
    assert d[0]["Text"] == 'We cut taxes, "big" time' and d[0]["Verdict"] == 1 and d[1]["Verdict"] == -1
    _write(os.path.join(scratch, "all.csv"),
           'Sentence_id,Text,Speaker,Speaker_title,Speaker_party,File_id,Length,Line_number,Sentiment,Speaker_role\n'
           '7,Hello,C,,,f2,1,1,0.0,Moderator\n')
    a = read_debate_sentences(spark, os.path.join(scratch, "all.csv"), all_sentences=True).first()
    assert a["Speaker_role"] == "Moderator" and "Verdict" not in a.asDict()
    _write(os.path.join(scratch, "ratio.json"),
           '[{"sentence_id": 3, "label": 1, "text": "a claim"},\n {"sentence_id": 4, "label": 0, "text": "no"}]')
    j = read_curated_json(spark, os.path.join(scratch, "ratio.json")).orderBy("sentence_id").collect()
    assert [(r["sentence_id"], r["label"], r["text"]) for r in j] == [(3, 1, "a claim"), (4, 0, "no")]


def test_scalar_text_helpers(spark):
    from worthrank.functions.scalar import fixed, strip_cr, to_double, to_int

    df = spark.createDataFrame([("12\r", " 3.5 ", "x", 0.123456)], "a string, b string, c string, d double")
    r = df.select(strip_cr("a").alias("a"), to_int("a").alias("ai"), to_double("b").alias("b"),
                  to_int("c").alias("c"), fixed("d", 3).alias("d")).first()
    assert (r["a"], r["ai"], r["b"], r["c"], r["d"]) == ("12", 12, 3.5, None, "0.123")


def test_prediction_parsers_keep_file_order(spark, scratch):
    from worthrank.sources.readers import parse_predictions_2019, parse_predictions_2020

    _write(os.path.join(scratch, "run.tsv"),
           "covid\t1237160250513522688\t0.5\tModel_1\ncovid\t1237160250513522689\t0.5\tModel_1\n"
           "covid\t1237160250513522690\t0.9\tModel_1")
    p = parse_predictions_2020(read_lines(spark, os.path.join(scratch, "run.tsv"))).orderBy("pos").collect()
    assert [(r["pos"], str(r["tweet_id"])[-3:], r["score"], r["n_fields"]) for r in p] == \
        [(1, "688", 0.5, 4), (2, "689", 0.5, 4), (3, "690", 0.9, 4)]
    _write(os.path.join(scratch, "d.tsv"), "1\t0.25\n2\tx")
    q = parse_predictions_2019(read_lines(spark, os.path.join(scratch, "d.tsv"))).orderBy("pos").collect()
    assert [(r["line_number"], r["score"]) for r in q] == [(1, 0.25), (2, None)]
