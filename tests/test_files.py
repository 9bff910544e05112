"""Line numbers, named split files and the run log, on files written to fresh folders."""

import datetime as dt
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from worthrank.operators.validate import check_gold
from worthrank.sinks import writers
from worthrank.sinks.writers import RUN_LOG_SCHEMA, append_run_log, append_runs, read_run_log, write_named_rankings
from worthrank.sources import readers
from worthrank.sources.readers import parse_gold_2020, read_corpus, read_lines


def put(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("".join(x + "\n" for x in lines))


@pytest.fixture()
def small_splits(spark):
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
    spark.conf.set("spark.sql.files.openCostInBytes", held[1])


def test_line_numbers_add_up_over_splits_and_files(spark, tmp_path, small_splits, monkeypatch):
    docs = {"big": [f"big line {i}" for i in range(900)], "small": ["", "x", "", ""], "one": ["a"]}
    for name, lines in docs.items():
        put(f"{tmp_path}/in/{name}.tsv", lines)
    for limit in (readers.SPLITS_LIMIT, 0):  # with a broadcast and without
        monkeypatch.setattr(readers, "SPLITS_LIMIT", limit)
        got = read_lines(spark, f"{tmp_path}/in")
        assert sorted((r.doc_id, r.pos, r.line) for r in got.collect()) == sorted((d, i + 1, x) for d, v in docs.items() for i, x in enumerate(v))
    assert spark.read.text(f"{tmp_path}/in").rdd.getNumPartitions() > 5


def test_part_files_follow_each_other_by_number(spark, tmp_path, small_splits):
    names = ["part-00009-x.txt", "part-100000-x.txt", "part-99999-x.txt", "part-00010-x.txt"]
    for doc in ("a", "b"):
        for n in names:
            put(f"{tmp_path}/d/doc_id={doc}/{n}", [f"{doc} {int(n.split('-')[1])} {i}" for i in range(60)])
    expected = [(d, f"{d} {n} {i}") for d in "ab" for n in (9, 10, 99999, 100000) for i in range(60)]
    for doc_from in ("partition", "directory"):
        got = read_lines(spark, f"{tmp_path}/d" if doc_from == "partition" else f"{tmp_path}/d/*", doc_from=doc_from).collect()
        rows = sorted((r.doc_id.removeprefix("doc_id="), r.pos, r.line) for r in got)
        assert [(d, x) for d, _, x in rows] == expected
        assert [p for _, p, _ in rows] == list(range(1, 241)) * 2


def test_no_line_is_shuffled_to_be_numbered(spark, tmp_path):
    put(f"{tmp_path}/in/a.tsv", ["x"] * 50)
    plan = read_lines(spark, f"{tmp_path}/in")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert not [x for x in plan.split("\n") if "Exchange" in x and "BroadcastExchange" not in x]


def test_wrong_gold_lines_of_2020_are_refused(spark, tmp_path):
    good = "topic-1\t1234567890123456789\turl\ttext\t1\t0"
    put(f"{tmp_path}/good.tsv", ["topic_id\ttweet_id\ttweet_url\ttweet_text\tclaim\tcheck_worthiness", good])
    assert check_gold(parse_gold_2020(read_lines(spark, f"{tmp_path}/good.tsv")), 6, "tweet_id").count() == 1
    for bad in ("topic-1\t12345\turl\ttext\t1", "topic-1\tx\turl\ttext\t1\t0", "topic-1\t12345\turl\ttext\t1\tyes", "topic-1\t1\turl\ta\tb\t1\t0"):
        put(f"{tmp_path}/bad.tsv", [good, bad])
        with pytest.raises(ValueError, match="bad gold line"):
            check_gold(parse_gold_2020(read_lines(spark, f"{tmp_path}/bad.tsv")), 6, "tweet_id")


def test_corpus_and_phase_name_the_source(spark, tmp_path):
    put(f"{tmp_path}/t/d1.tsv", ["1\tA\tsaid\t1"])
    put(f"{tmp_path}/all.csv", ["Sentence_id,Text,Speaker,Speaker_title,Speaker_party,File_id,Length,Line_number,Sentiment,Speaker_role", "1,x,A,t,p,f,1,1,0.5,r"])
    put(f"{tmp_path}/c.json", ['[{"sentence_id": 3, "label": 1, "text": "t"}]'])
    assert read_corpus(spark, f"{tmp_path}/t", "transcripts").first()["doc_id"] == "d1"
    assert "Verdict" not in read_corpus(spark, f"{tmp_path}/all.csv", "debates", "test").columns
    assert "Verdict" in read_corpus(spark, f"{tmp_path}/all.csv", "debates", "val").columns
    assert read_corpus(spark, f"{tmp_path}/c.json", "curated").first()["sentence_id"] == 3
    for corpus, phase in (("curated", "test"), ("other", "train"), ("tweets", "run")):
        with pytest.raises(ValueError):
            read_corpus(spark, f"{tmp_path}/t", corpus, phase)


def rankings(spark):
    return spark.createDataFrame([(d, i, 1 / i) for d, n in (("a", 40), ("b=c d", 3), ("e.tsv", 1)) for i in range(n, 0, -1)], "doc_id string, line_number int, score double").repartition(5)


def check_rankings(path):
    for name, n in (("a", 40), ("b=c d", 3), ("e", 1)):
        with open(f"{path}/{name}_out.tsv") as f:
            assert f.read().split("\n")[:-1] == [f"{i}\t{1 / i:.5f}" for i in range(1, n + 1)]


def test_one_named_file_per_document(spark, tmp_path):
    path = f"{tmp_path}/out"
    assert write_named_rankings(rankings(spark), path) == ["a_out.tsv", "b=c d_out.tsv", "e_out.tsv"]
    check_rankings(path)
    write_named_rankings(rankings(spark), path)  # again: the files are replaced
    check_rankings(path)
    assert not [x for x in os.listdir(path) if "staging" in x]


def test_renames_go_on_after_a_lost_driver(spark, tmp_path, monkeypatch):
    path, calls, move = f"{tmp_path}/out", [], writers._move

    def dies(fs, source, target):
        calls.append(target)
        if len(calls) == 2:
            raise RuntimeError("driver lost")
        return move(fs, source, target)

    monkeypatch.setattr(writers, "_move", dies)
    with pytest.raises(RuntimeError):
        write_named_rankings(rankings(spark), path)
    monkeypatch.setattr(writers, "_move", move)
    # what has been written counts, the rows of the second call are not written again
    assert len(write_named_rankings(rankings(spark).where("false"), path)) == 3
    check_rankings(path)


def records(spark, first, n):
    return spark.createDataFrame([(dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i), "train", {"k": str(i)}, {"elapsed_seconds": str(i)}) for i in range(first, first + n)], RUN_LOG_SCHEMA)


def test_appends_at_the_same_time_lose_nothing_and_retries_add_nothing(spark, tmp_path):
    path = f"{tmp_path}/log"
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: append_runs(records(spark, 10 * k, 10), path, f"w{k}"), range(6)))
    assert append_runs(records(spark, 0, 10), path, "w0") is False
    append_run_log(spark, path, "test", {"a": 1}, {"elapsed_seconds": 3661}, dt.datetime(2021, 1, 1))
    log = read_run_log(spark, path)
    assert log.count() == 61 and log.select("run_ts").distinct().count() == 61
    newest = read_run_log(spark, path, newest=3)
    assert [(r.phase, r.elapsed) for r in newest.collect()] == [("test", "1:01:01"), ("train", "0:00:59"), ("train", "0:00:58")]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_an_append_that_was_cut_off_is_not_seen(spark, tmp_path):
    path = f"{tmp_path}/log"
    append_runs(records(spark, 0, 5), path, "a")
    records(spark, 5, 5).write.parquet(f"{path}/_staging-b-1")  # the driver died before the rename
    assert read_run_log(spark, path).count() == 5
    assert append_runs(records(spark, 5, 5), path, "b") and read_run_log(spark, path).count() == 10


def test_late_rows_are_dropped_by_the_watermark(spark):
    from worthrank.streaming.scoring import run_arrivals, window_counts

    def rows(*hours):
        return spark.createDataFrame([(dt.datetime(2020, 1, 1) + dt.timedelta(hours=h), "k", 1) for h in hours], "ts timestamp, k string, v int")

    # after 5.5 the mark is at 4.5: windows up to 3 to 4 are closed, 4 to 5 is open
    counts, progress = run_arrivals([rows(0.2, 0.4, 5.5), rows(0.5, 3.9, 4.2, 5.6), rows(30.0)], lambda s: window_counts(s, "ts", "k", F.col("v") > 0), "late-test")
    assert sorted((r.window_start.hour, r.n) for r in counts.collect()) == [(0, 2), (4, 1), (5, 2)]
    assert sum(p["late_groups"] for p in progress) == 2
    assert progress[-1]["state_rows"] == 1  # only the last window's state is kept
