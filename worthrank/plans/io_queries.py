"""Registered source/sink round trips (S1, S3, S7, S9-S12, K1, K2, K4, P7, P8) and the
file-based evaluation flow (gold files + ranking files -> checks -> metrics).

Each query writes whole derived tables to a fresh directory under the shared checkpoint
directory and reads them back through the readers; the oracle computes the same rows straight
from the source tables, so any loss in writing or parsing shows as a mismatch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from worthrank.operators.metrics import ranking_metrics
from worthrank.operators.prepare import dedupe_last
from worthrank.operators.sequences import document_sequences
from worthrank.operators.validate import split_output_check
from worthrank.plans.ranking_queries import PER_TOPIC_SELECT, per_topic_sql
from worthrank.plans.registry import register, round6
from worthrank.plans.validation_queries import NUMBERED_G1_SQL, TWEET_ID_BASE, numbered_g1
from worthrank.session import scratch_path
from worthrank.functions.scalar import binarize, split_file_name, word_count
from worthrank.sinks.writers import (append_runs, read_run_log, write_curated_json, write_debate_sentences, write_named_rankings,
                                     write_ranking, write_ranking_2020, write_transcripts, write_tweets)
from worthrank.sources.readers import (TWEET_ID, parse_gold_2019, parse_gold_2020, parse_predictions_2019, parse_predictions_2020,
                                       read_corpus, read_debate_sentences, read_lines,
                                       read_predictions_2019, read_predictions_2020, read_transcripts, read_tweets)
from worthrank.sources.testdata import table


@register("ranking_file_rows", "WITH " + NUMBERED_G1_SQL + """
SELECT topic_id AS doc_id, CAST(ln AS INTEGER) AS line_number,
       CAST(printf('%.5f', round_even(score, 5)) AS DOUBLE) AS score
FROM n""", "K1 K4 P8 S9 S11 S12: 2019 rankings written per document (5 decimals) and read back")
def q_ranking_file_rows(spark, sf_dir):
    n = numbered_g1(spark, sf_dir)
    path = scratch_path(spark, "rank2019")
    write_ranking(n.select(F.col("topic_id").alias("doc_id"), F.col("ln").alias("line_number"), "score"),
                  path, "transcripts")
    back = read_predictions_2019(spark, path, doc_from="partition")
    return back.select("doc_id", "line_number", "score")


@register("transcript_roundtrip", """
SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn + 1 AS INTEGER) AS line_number, role AS speaker,
       text AS statement, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS label
FROM conversations""",
          "S1 K4: transcripts (quoted dialect: tabs, quotes, newlines in statements) written per "
          "document and read back")
def q_transcript_roundtrip(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = c.select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("line_number"),
                 F.col("role").alias("speaker"), F.col("text").alias("statement"),
                 F.when(F.col("role") == "user", 1).otherwise(0).alias("label"))
    path = scratch_path(spark, "transcripts")
    write_transcripts(t, path)
    back = read_transcripts(spark, path, dialect="quoted", doc_from="partition", multiline=True)
    return back.select("doc_id", "line_number", "speaker", "statement", "label")


@register("tweet_roundtrip", f"""
SELECT d.source AS topic_id, CAST({TWEET_ID_BASE} + d.doc_id AS VARCHAR) AS tweet_id,
       length(d.text) AS n_chars, md5(d.text) AS text_md5, l.toxic AS check_worthiness
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
          "S3: headered tweet TSV with 19-digit DECIMAL(23,0) ids and multi-line texts, round trip")
def q_tweet_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    tweets = d.select(F.col("source").alias("topic_id"),
                      (F.lit(TWEET_ID_BASE) + F.col("doc_id")).cast(TWEET_ID).alias("tweet_id"),
                      F.concat(F.lit("https://example.org/status/"), F.col("doc_id")).alias("tweet_url"),
                      F.col("text").alias("tweet_text"), F.lit(1).alias("claim"),
                      F.col("toxic").alias("check_worthiness"))
    path = scratch_path(spark, "tweets")
    write_tweets(tweets, path)
    back = read_tweets(spark, path)
    return back.select("topic_id", F.col("tweet_id").cast("string").alias("tweet_id"),
                       F.length("tweet_text").cast("bigint").alias("n_chars"),
                       F.md5(F.col("tweet_text").cast("binary")).alias("text_md5"), "check_worthiness")


@register("ranking_2020_roundtrip", "WITH " + NUMBERED_G1_SQL + f"""
SELECT topic_id, CAST({TWEET_ID_BASE} + item_id AS VARCHAR) AS tweet_id,
       CAST(printf('%.5f', round_even(score, 5)) AS DOUBLE) AS score, 'Model_1' AS run_id
FROM n""", "K2 P7 S10: 2020 rankings with the constant run id, written and read back")
def q_ranking_2020_roundtrip(spark, sf_dir):
    g = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("source").alias("topic_id"), (F.lit(TWEET_ID_BASE) + F.col("doc_id")).cast(TWEET_ID).alias("tweet_id"),
        ((F.col("n_chars") % 97).cast("double") / 97.0).alias("score"))
    path = scratch_path(spark, "rank2020")
    write_ranking_2020(g, path)
    back = read_predictions_2020(spark, path)
    return back.select("topic_id", F.col("tweet_id").cast("string").alias("tweet_id"), "score", "run_id")


#: A topic is cut into documents of so many lines; the format has room for line numbers up to 9,999.
DOC_LINES = 9000

FILE_EVAL_SQL = "WITH " + NUMBERED_G1_SQL + """,
g5 AS (SELECT n.topic_id || '_' || CAST((n.ln - 1) // """ + str(DOC_LINES) + """ AS VARCHAR) AS topic_id, n.ln AS pos, n.label, CAST(printf('%.5f', round_even(n.score, 5)) AS DOUBLE) AS score FROM n),
r AS (SELECT g5.*,
             row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, pos ASC) AS rnk,
             SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY topic_id ORDER BY score DESC, pos ASC
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY topic_id) AS r_tot
      FROM g5),
m AS (""" + per_topic_sql() + ")\nSELECT " + PER_TOPIC_SELECT + " FROM m"


@register("file_based_evaluation", FILE_EVAL_SQL,
          "S7 S9 J1 V1 A9: gold transcripts and ranking files written per document, read back "
          "raw, format-checked, joined by (document, line number) and scored")
def q_file_based_evaluation(spark, sf_dir):
    from worthrank.operators.validate import check_coverage, check_gold, line_violations_2019

    before = F.col("ln") - 1
    n = (numbered_g1(spark, sf_dir).withColumn("topic_id", F.concat_ws("_", "topic_id", F.floor(before / DOC_LINES).cast("string")))
         .withColumn("ln", before % DOC_LINES + 1))
    gold_path, pred_path = scratch_path(spark, "gold2019"), scratch_path(spark, "pred2019")
    write_transcripts(n.select(F.col("topic_id").alias("doc_id"), F.col("ln").alias("line_number"),
                               F.col("lang").alias("speaker"),
                               F.concat(F.lit("sentence "), F.col("item_id")).alias("statement"), "label"),
                      gold_path)
    write_ranking(n.select(F.col("topic_id").alias("doc_id"), F.col("ln").alias("line_number"), "score"),
                  pred_path, "transcripts")
    gold = check_gold(parse_gold_2019(read_lines(spark, gold_path, doc_from="partition")).checkpoint(), 4, "line_number")
    pred_lines = read_lines(spark, pred_path, doc_from="partition")
    bad = line_violations_2019(pred_lines).first()
    if bad is not None:
        raise ValueError(f"bad ranking line: {bad.asDict()}")
    pred = read_predictions_2019(spark, pred_path, doc_from="partition")
    check_coverage(gold.select("doc_id", "line_number"), pred.select("doc_id", "line_number"),
                   ["doc_id", "line_number"], strict=True)
    # gold as a dict: the last line per (document, line number) wins (D1); R counts its positives
    gold_last = dedupe_last(gold, ["doc_id", "line_number"], ["pos"], ["label"])
    joined = pred.join(gold_last.select("doc_id", "line_number", "label"), ["doc_id", "line_number"])
    relevant = gold_last.groupBy(F.col("doc_id").alias("topic_id")).agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("n_rel"))
    per = ranking_metrics(joined.withColumnRenamed("doc_id", "topic_id"), ["topic_id"],
                          tie_cols=("line_number",), relevant=relevant)
    return round6(per)


@register("source_sink_roundtrip", r"""
SELECT d.doc_id AS sentence_id, d.source AS speaker,
       CAST(CASE WHEN regexp_replace(d.text, '^\s+|\s+$', '', 'g') = '' THEN 0
            ELSE len(regexp_split_to_array(regexp_replace(d.text, '^\s+|\s+$', '', 'g'), '\s+')) END AS INTEGER) AS length,
       CASE WHEN l.quality = 1 THEN 1 WHEN l.toxic = 1 THEN -1 ELSE 0 END AS verdict,
       CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS label,
       CAST(length(d.text) AS BIGINT) AS text_len, md5(d.text) AS text_md5
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
          "S4 P2 F13 K-sink: debate sentences (comma CSV, quoted dialect, three-valued verdict) "
          "written and read back, verdict binarised")
def q_source_sink_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    sentences = d.select(
        F.col("doc_id").alias("Sentence_id"), F.col("text").alias("Text"), F.col("source").alias("Speaker"),
        F.lit(None).cast("string").alias("Speaker_title"), F.col("lang").alias("Speaker_party"),
        F.col("source").alias("File_id"), word_count("text").alias("Length"),
        F.col("doc_id").cast("int").alias("Line_number"), F.lit(0.0).alias("Sentiment"),
        F.when(F.col("quality") == 1, 1).when(F.col("toxic") == 1, -1).otherwise(0).alias("Verdict"))
    path = scratch_path(spark, "debates")
    write_debate_sentences(sentences, path)
    back = read_debate_sentences(spark, path)
    return back.select(F.col("Sentence_id").alias("sentence_id"), F.col("Speaker").alias("speaker"),
                       F.col("Length").alias("length"), F.col("Verdict").alias("verdict"),
                       binarize("Verdict").alias("label"), F.length("Text").cast("bigint").alias("text_len"),
                       F.md5(F.col("Text").cast("binary")).alias("text_md5"))


FILE_EVAL_2020_SQL = f"""
WITH g AS (SELECT d.source AS topic_id, {TWEET_ID_BASE} + d.doc_id AS tid, l.toxic AS label,
                  CAST(printf('%.5f', round_even(CAST(d.n_chars % 97 AS DOUBLE) / 97.0, 5)) AS DOUBLE) AS score
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
f AS (SELECT g.*, row_number() OVER (ORDER BY topic_id, tid) AS pos FROM g),
r AS (SELECT 'run_2020' AS topic_id, label,
             row_number() OVER (ORDER BY score DESC, pos ASC) AS rnk,
             SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER (ORDER BY score DESC, pos ASC
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER () AS r_tot
      FROM f),
m AS ({per_topic_sql()})
SELECT {PER_TOPIC_SELECT} FROM m"""


@register("file_based_evaluation_2020", FILE_EVAL_2020_SQL,
          "S3 S8 S10 V2 V4 J1 A9 (2020): gold tweets and one sorted run written as files, read back raw "
          "with their global line position, checked, joined by tweet id and scored as one ranking "
          "(ties in file order, R from the gold file)")
def q_file_based_evaluation_2020(spark, sf_dir):
    from worthrank.operators.validate import check_coverage, check_gold, line_violations_2020

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    tweets = d.select(F.col("source").alias("topic_id"),
                      (F.lit(TWEET_ID_BASE) + F.col("doc_id")).cast(TWEET_ID).alias("tweet_id"),
                      F.concat(F.lit("https://example.org/status/"), F.col("doc_id")).alias("tweet_url"),
                      # one line per tweet, as in the task's gold files
                      F.regexp_replace("text", r"[\t\r\n]+", " ").alias("tweet_text"),
                      F.lit(1).alias("claim"), F.col("toxic").alias("check_worthiness"),
                      ((F.col("n_chars") % 97).cast("double") / 97.0).alias("score"))
    base = scratch_path(spark, "eval2020")
    gold_path, run_path = f"{base}/gold_2020", f"{base}/run_2020"
    write_tweets(tweets, gold_path)
    # the run file lists tweets by topic and id; equal scores keep that physical order
    write_ranking_2020(tweets.orderBy("topic_id", "tweet_id"), run_path)
    gold = check_gold(parse_gold_2020(read_lines(spark, gold_path, doc_from="directory")), 6, "tweet_id")
    run_lines = read_lines(spark, run_path, doc_from="directory")
    bad = line_violations_2020(run_lines).first()
    if bad is not None:
        raise ValueError(f"bad ranking line: {bad.asDict()}")
    pred = parse_predictions_2020(run_lines)
    check_coverage(gold.select("tweet_id"), pred.select("tweet_id"), ["tweet_id"], strict=True)
    gold_last = dedupe_last(gold, ["tweet_id"], ["pos"], ["label"])
    joined = pred.join(gold_last.select("tweet_id", "label"), "tweet_id")
    # one ranking per run file (the directory); the topic field of the lines is not a group here
    ranked_input = joined.drop("topic_id").withColumnRenamed("doc_id", "topic_id")
    # R = positives of the gold file, attached to the run keys found in the data (a scalar
    # subquery, so the metrics join stays an equi-join on a real key)
    gold_positives = gold_last.agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0))).scalar()
    relevant = ranked_input.select("topic_id").distinct().withColumn("n_rel", gold_positives)
    per = ranking_metrics(ranked_input, ["topic_id"], tie_cols=("pos",), relevant=relevant)
    return round6(per)


@register("named_split_files", "WITH " + NUMBERED_G1_SQL + """
SELECT topic_id || '_out.tsv' AS file_name, COUNT(*) AS n_original, COUNT(*) AS n_produced, CAST(arg_min(ln, pos) AS INTEGER) AS first_id,
       arg_min(ln, pos) = 1 AS ok, CAST(printf('%.5f', round_even(arg_max(score, ln), 5)) AS DOUBLE) AS last_score
FROM n GROUP BY topic_id""", "K4 V5 F4 L2: one file <document>_out.tsv per document by staging and rename, listed and read back: row "
          "counts agree with the originals and every file starts with id 1")
def q_named_split_files(spark, sf_dir):
    n = numbered_g1(spark, sf_dir).select(F.col("topic_id").alias("doc_id"), F.col("ln").alias("line_number"), "score")
    path = scratch_path(spark, "split-files")
    write_named_rankings(n, path)
    lines = parse_predictions_2019(read_lines(spark, path)).withColumn("file_name", F.concat("doc_id", F.lit(".tsv")))
    produced = lines.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_produced"), F.min_by("line_number", "pos").alias("first_id"),
                                              F.max_by("score", "pos").alias("last_score"))
    original = n.groupBy(split_file_name("doc_id").alias("file_name")).agg(F.count(F.lit(1)).alias("n_original"))
    return split_output_check(original, produced, "file_name").select("file_name", "n_original", "n_produced", "first_id", "ok", "last_score")


@register("run_log_recent", """
SELECT event_type AS phase, CAST(event_id AS VARCHAR) AS run, CAST(user_id AS VARCHAR) AS user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS run_ts
FROM events ORDER BY ts DESC, event_id DESC LIMIT 200""",
          "K6 L5: a run log written by concurrent appends, one of them retried, and its 200 newest records read back by a bounded top-k")
def q_run_log_recent(spark, sf_dir):
    from concurrent.futures import ThreadPoolExecutor

    e = table(spark, sf_dir, "events")
    runs = e.select(F.col("ts").cast("timestamp").alias("run_ts"), F.col("event_type").alias("phase"),
                    F.create_map(F.lit("user_id"), F.col("user_id").cast("string")).alias("settings"),
                    F.create_map(F.lit("elapsed_seconds"), F.col("value").cast("string"), F.lit("run"), F.col("event_id").cast("string")).alias("stats"),
                    (F.col("event_id") % 4).alias("writer"))
    path = scratch_path(spark, "run-log")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: append_runs(runs.where(F.col("writer") == k), path, f"writer-{k}"), [0, 1, 2, 3, 0]))
    log = read_run_log(spark, path, newest=200, ties=[F.col("stats")["run"].cast("bigint")])
    return log.select("phase", F.col("stats")["run"].alias("run"), F.col("settings")["user_id"].alias("user_id"), F.date_format("run_ts", "yyyy-MM-dd HH:mm:ss").alias("run_ts"))


@register("document_sequences", """
WITH c AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS doc_id, conv_id, turn, text, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS label FROM conversations)
SELECT doc_id, row_number() OVER w AS pos, md5(text) AS text_md5, label, COUNT(*) OVER (PARTITION BY doc_id) AS n_in_doc,
       md5(lag(text) OVER w) AS previous_md5, md5(lead(text) OVER w) AS next_md5
FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY conv_id, turn)""",
          "S2: documents as sequences with their content: position, length, text before and after; one document holds a third of all rows")
def q_document_sequences(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    docs = c.select(F.when(F.col("conv_id") % 3 == 0, 0).otherwise(F.col("conv_id")).alias("doc_id"), "conv_id", "turn", "text",
                    F.when(F.col("role") == "user", 1).otherwise(0).alias("label"))
    seq = document_sequences(docs, "doc_id", ["conv_id", "turn"], "text")
    return seq.select("doc_id", "pos", F.md5("text").alias("text_md5"), "label", "n_in_doc", F.md5("previous").alias("previous_md5"), F.md5("next").alias("next_md5"))


@register("sentence_sources", """
SELECT doc_id AS sentence_id, length(text) AS n_chars, md5(text) AS text_md5, lang AS speaker_role, CAST(NULL AS INTEGER) AS label FROM documents WHERE doc_id % 2 = 0
UNION ALL
SELECT doc_id, length(text), md5(text), NULL, CAST(doc_id % 3 AS INTEGER) FROM documents WHERE doc_id % 2 = 1""",
          "S5 S6 S12 K3 P8: sentences without a verdict from two paths, curated sentences from JSON lists, both by corpus and phase; "
          "no ranking is written for their corpus")
def q_sentence_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    base, number = scratch_path(spark, "sentences"), F.lit(0).cast("int")
    rows = d.where("doc_id % 2 = 0").select(
        F.col("doc_id").alias("Sentence_id"), F.col("text").alias("Text"), F.lit("s").alias("Speaker"), F.lit("t").alias("Speaker_title"),
        F.lit("p").alias("Speaker_party"), F.lit("f").alias("File_id"), number.alias("Length"), number.alias("Line_number"),
        F.lit(0.5).alias("Sentiment"), F.col("lang").alias("Speaker_role"))
    write_debate_sentences(rows.where("Sentence_id % 4 = 0"), f"{base}/a", all_sentences=True)
    write_debate_sentences(rows.where("Sentence_id % 4 = 2"), f"{base}/b", all_sentences=True)
    write_curated_json(d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("sentence_id"), (F.col("doc_id") % 3).cast("int").alias("label"), "text"), f"{base}/c")
    debates, curated = read_corpus(spark, f"{base}/a , {base}/b", "debates", "test"), read_corpus(spark, f"{base}/c", "curated")
    if write_ranking(debates, f"{base}/ranking", "debates") is not None:
        raise ValueError("the debate sentences have no ranking format")
    size, digest = F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5")
    return (debates.withColumnsRenamed({"Text": "text", "Sentence_id": "sentence_id", "Speaker_role": "speaker_role"})
            .select("sentence_id", size, digest, "speaker_role", F.lit(None).cast("int").alias("label"))
            .unionByName(curated.select("sentence_id", size, digest, F.lit(None).cast("string").alias("speaker_role"), "label")))


GOLD_LINE_SQL = """
SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'x' ELSE CAST(doc_id + 1 AS VARCHAR) END AS a,
       CASE WHEN doc_id % 7 = 2 THEN 3 WHEN doc_id % 7 = 5 THEN 5 ELSE 4 END AS n_fields,
       CASE WHEN doc_id % 13 = 4 THEN 'yes' ELSE CAST(doc_id % 2 AS VARCHAR) END AS z
FROM documents"""


@register("gold_violations", f"""
WITH g AS ({GOLD_LINE_SQL}),
v AS (SELECT doc_id, n_fields, n_fields <> 4 AS wrong_fields, n_fields >= 4 AND z = 'yes' AND n_fields = 4 AS bad_label, a = 'x' AS bad_line FROM g)
SELECT 'gold_' || CAST(doc_id % 5 AS VARCHAR) AS doc_id, rule, COUNT(*) AS n FROM (
  SELECT doc_id, 'fields' AS rule FROM v WHERE wrong_fields
  UNION ALL SELECT doc_id, 'line_number' FROM v WHERE NOT wrong_fields AND bad_line
  UNION ALL SELECT doc_id, 'label' FROM v WHERE NOT wrong_fields AND NOT bad_line AND bad_label)
GROUP BY ALL""", "S7: gold lines of a wrong shape, counted by document and rule")
def q_gold_violations(spark, sf_dir):
    from worthrank.operators.validate import gold_violations

    d = table(spark, sf_dir, "documents").select("doc_id")
    first = F.when(F.col("doc_id") % 11 == 3, "x").otherwise((F.col("doc_id") + 1).cast("string"))
    label = F.when(F.col("doc_id") % 13 == 4, "yes").otherwise((F.col("doc_id") % 2).cast("string"))
    line = (F.when(F.col("doc_id") % 7 == 2, F.concat_ws("\t", first, F.lit("speaker"), label))
            .when(F.col("doc_id") % 7 == 5, F.concat_ws("\t", first, F.lit("speaker"), F.lit("said"), label, F.lit("more")))
            .otherwise(F.concat_ws("\t", first, F.lit("speaker"), F.lit("said"), label)))
    path = scratch_path(spark, "gold-lines")
    d.select(F.concat(F.lit("gold_"), F.col("doc_id") % 5).alias("doc_id"), line.alias("value")).write.partitionBy("doc_id").text(path)
    gold = parse_gold_2019(read_lines(spark, path, doc_from="partition"))
    return gold_violations(gold, 4, "line_number").groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))
