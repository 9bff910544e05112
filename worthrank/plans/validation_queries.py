"""Registered validation queries: V1-V5, J2-J4, J6, D1, W4, W5, P4-P6, F1-F3, A16, U3, U4."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthrank.functions.scalar import DEFAULT_RUN_ID, fixed
from worthrank.operators.prepare import dedupe_last
from worthrank.operators.ranking import rank_within
from worthrank.operators.validate import (coverage_violations, file_validity, line_violations_2019,
                                          line_violations_2020, manifest_check, split_output_check)
from worthrank.plans.ranking_queries import G1_SQL
from worthrank.plans.registry import register
from worthrank.session import checkpoint_dir
from worthrank.sources.testdata import labelled_documents, table

TWEET_ID_BASE = 1_200_000_000_000_000_000  # 19-digit ids, inside the 17-23 digit grammar


# --------------------------------------------------------------------- G4: ranking lines

def numbered_g1(spark, sf_dir) -> DataFrame:
    """G1 with ``ln`` = 1-based line number of the row in its topic's ranking file."""
    g1 = labelled_documents(spark, sf_dir, "quality")
    return rank_within(g1, ["topic_id"], ["pos"]).withColumnRenamed("row_number", "ln")


def lines_2019(spark, sf_dir) -> DataFrame:
    """One 2019 ranking file per topic. German rows are written with an exponent score and French
    rows with a shifted line number, so both rules have violations to find."""
    n = numbered_g1(spark, sf_dir)
    ln = F.col("ln").cast("string")
    line = (F.when(F.col("lang") == "de", F.concat(ln, F.lit("\t"), F.format_string("%.2e", "score")))
            .when(F.col("lang") == "fr", F.concat((F.col("ln") + 1).cast("string"), F.lit("\t"), fixed("score", 5)))
            .otherwise(F.concat(ln, F.lit("\t"), fixed("score", 5))))
    return n.select(F.col("topic_id").alias("doc_id"), F.col("ln").alias("pos"), line.alias("line"))


def lines_2020(spark, sf_dir) -> DataFrame:
    """One 2020 ranking file per topic; German rows carry a too-short id and Spanish rows lack
    the run id field."""
    n = numbered_g1(spark, sf_dir)
    tweet = (F.lit(TWEET_ID_BASE) + F.col("item_id")).cast("string")
    score = fixed("score", 5)
    line = (F.when(F.col("lang") == "de", F.concat_ws("\t", "topic_id", F.col("item_id").cast("string"), score,
                                                      F.lit(DEFAULT_RUN_ID)))
            .when(F.col("lang") == "es", F.concat_ws("\t", "topic_id", tweet, score))
            .otherwise(F.concat_ws("\t", "topic_id", tweet, score, F.lit(DEFAULT_RUN_ID))))
    return n.select(F.col("topic_id").alias("doc_id"), F.col("ln").alias("pos"), line.alias("line"))


NUMBERED_G1_SQL = f"""
g AS ({G1_SQL.format(label='quality')}),
n AS (SELECT g.*, row_number() OVER (PARTITION BY topic_id ORDER BY pos) AS ln FROM g)"""

LINES_2019_SQL = NUMBERED_G1_SQL + """,
lines AS (
  SELECT topic_id AS doc_id, ln AS pos,
         CASE WHEN lang = 'de' THEN CAST(ln AS VARCHAR) || chr(9) || printf('%.2e', score)
              WHEN lang = 'fr' THEN CAST(ln + 1 AS VARCHAR) || chr(9) || printf('%.5f', score)
              ELSE CAST(ln AS VARCHAR) || chr(9) || printf('%.5f', score) END AS line
  FROM n)"""

LINES_2020_SQL = NUMBERED_G1_SQL + f""",
lines AS (
  SELECT topic_id AS doc_id, ln AS pos,
         CASE WHEN lang = 'de' THEN concat_ws(chr(9), topic_id, CAST(item_id AS VARCHAR), printf('%.5f', score), 'Model_1')
              WHEN lang = 'es' THEN concat_ws(chr(9), topic_id, CAST({TWEET_ID_BASE} + item_id AS VARCHAR), printf('%.5f', score))
              ELSE concat_ws(chr(9), topic_id, CAST({TWEET_ID_BASE} + item_id AS VARCHAR), printf('%.5f', score), 'Model_1')
         END AS line
  FROM n)"""

CONTENT_SQL = r""",
b AS (
  SELECT doc_id,
         MIN(CASE WHEN regexp_replace(line, '^\s+|\s+$', '', 'g') <> '' THEN pos END) AS first_pos,
         MAX(CASE WHEN regexp_replace(line, '^\s+|\s+$', '', 'g') <> '' THEN pos END) AS last_pos,
         MIN(pos) AS min_pos
  FROM lines GROUP BY doc_id),
c AS (
  SELECT l.doc_id, l.pos, l.line,
         COALESCE(l.pos - b.first_pos, 0) + 1 AS i,
         CASE WHEN b.first_pos IS NULL THEN '' ELSE regexp_replace(l.line, '^\s+|\s+$', '', 'g') END AS s
  FROM lines l JOIN b ON l.doc_id = b.doc_id
  WHERE (b.first_pos IS NULL AND l.pos = b.min_pos) OR (l.pos BETWEEN b.first_pos AND b.last_pos))"""

V2019_SQL = "WITH " + LINES_2019_SQL + CONTENT_SQL + r""",
v AS (
  SELECT doc_id, CAST(pos AS BIGINT) AS pos,
         CASE WHEN NOT regexp_matches(s, '^[1-9][0-9]{0,3}\t([-+]?\d*\.\d+|\d+)$') THEN 'bad_format'
              WHEN TRY_CAST(trim(split_part(s, chr(9), 1)) AS INTEGER) <> i THEN 'not_consecutive' END AS rule,
         line
  FROM c)
"""

V2020_SQL = "WITH " + LINES_2020_SQL + CONTENT_SQL + r""",
v AS (
  SELECT doc_id, CAST(pos AS BIGINT) AS pos,
         CASE WHEN len(string_split(s, chr(9))) <> 4 THEN 'field_count'
              WHEN NOT regexp_matches(string_split(s, chr(9))[2] || chr(9) || string_split(s, chr(9))[3],
                                      '^[1-9][0-9]{16,22}\t([-+]?\d*\.\d+|\d+)$') THEN 'bad_format' END AS rule,
         line
  FROM c)
"""


@register("format_violations_2019", V2019_SQL + "SELECT * FROM v WHERE rule IS NOT NULL",
          "V1 P5 W4 F1-F3: 2019 ranking-line grammar and consecutive numbering, all violations (G4)")
def q_format_2019(spark, sf_dir):
    return line_violations_2019(lines_2019(spark, sf_dir))


@register("format_violations_2020", V2020_SQL + "SELECT * FROM v WHERE rule IS NOT NULL",
          "V2 P6 F1-F3: 2020 field count and tweet-id/score grammar, all violations (G4)")
def q_format_2020(spark, sf_dir):
    return line_violations_2020(lines_2020(spark, sf_dir))


@register("file_validity_2019", V2019_SQL + """
SELECT d.doc_id, CAST(COALESCE(x.k, 0) AS BIGINT) AS n_violations, COALESCE(x.k, 0) = 0 AS valid
FROM (SELECT DISTINCT doc_id FROM lines) d
LEFT JOIN (SELECT doc_id, COUNT(*) AS k FROM v WHERE rule IS NOT NULL GROUP BY doc_id) x ON d.doc_id = x.doc_id""",
          "V1 check_format as one boolean per ranking file (G4)")
def q_file_validity(spark, sf_dir):
    lines = lines_2019(spark, sf_dir)
    return file_validity(lines.select("doc_id").distinct(), line_violations_2019(lines))


@register("coverage_violations", f"""
WITH g AS ({G1_SQL.format(label='quality')}),
gk AS (SELECT topic_id, item_id, COUNT(*) AS n_gold FROM g GROUP BY topic_id, item_id),
pk AS (SELECT source AS topic_id, doc_id AS item_id, COUNT(*) AS n_pred FROM documents
       WHERE lang = 'en' GROUP BY source, doc_id),
j AS (SELECT COALESCE(gk.topic_id, pk.topic_id) AS topic_id, COALESCE(gk.item_id, pk.item_id) AS item_id,
             n_gold, n_pred FROM gk FULL OUTER JOIN pk ON gk.topic_id = pk.topic_id AND gk.item_id = pk.item_id)
SELECT topic_id, item_id,
       CASE WHEN n_pred IS NULL THEN 'missing_prediction' WHEN n_gold IS NULL THEN 'unknown_prediction'
            WHEN n_pred > 1 THEN 'duplicate_prediction' END AS rule,
       CAST(COALESCE(n_gold, 0) AS BIGINT) AS n_gold, CAST(COALESCE(n_pred, 0) AS BIGINT) AS n_pred
FROM j WHERE n_pred IS NULL OR n_gold IS NULL OR n_pred > 1""",
          "V4 J2 J3 U3: gold rows without prediction and predictions without gold in one full outer join "
          "(gold = labelled documents, predictions = English documents)")
def q_coverage(spark, sf_dir):
    gold = labelled_documents(spark, sf_dir, "quality").select("topic_id", "item_id")
    pred = (table(spark, sf_dir, "documents").filter(F.col("lang") == "en")
            .select(F.col("source").alias("topic_id"), F.col("doc_id").alias("item_id")))
    return coverage_violations(gold, pred, ["topic_id", "item_id"])


@register("gold_last_wins", """
WITH e AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label
           FROM events),
r AS (SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM e)
SELECT user_id, event_id, event_type, label FROM r WHERE k = 1""",
          "D1: duplicate keys, the last row by position wins (events: last event per user)")
def q_gold_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn(
        "label", F.when(F.col("event_type") == "purchase", 1).otherwise(0))
    last = dedupe_last(e, ["user_id"], ["ts", "event_id"], ["event_type", "label"])
    return last.select("user_id", "event_id", "event_type", "label")


@register("manifest_check", V2019_SQL + """,
gold AS (SELECT row_number() OVER (ORDER BY source) AS pos, 'gold/' || source || '.tsv' AS gold_path
         FROM (SELECT DISTINCT source FROM documents)),
pred AS (SELECT row_number() OVER (ORDER BY doc_id) AS pos, doc_id, 'pred/' || doc_id || '.tsv' AS pred_path
         FROM (SELECT DISTINCT doc_id FROM lines)),
validity AS (SELECT p.pred_path, NOT EXISTS (SELECT 1 FROM v WHERE v.doc_id = p.doc_id AND v.rule IS NOT NULL) AS valid
             FROM pred p),
m AS (SELECT gold.gold_path, pred.pred_path FROM gold FULL OUTER JOIN pred ON gold.pos = pred.pos),
s AS (SELECT COUNT(m.gold_path) AS n_gold, COUNT(m.pred_path) AS n_pred, COUNT(DISTINCT m.pred_path) AS n_distinct_pred,
             CAST(SUM(CASE WHEN validity.valid = false THEN 1 ELSE 0 END) AS BIGINT) AS n_bad_files
      FROM m LEFT JOIN validity ON m.pred_path = validity.pred_path)
SELECT s.*, (n_gold = n_pred AND n_distinct_pred = n_pred AND n_bad_files = 0) AS valid FROM s""",
          "V3 J4 A16 U4: gold/prediction file lists paired by position, counts, repeats, format")
def q_manifest_check(spark, sf_dir):
    # the line table feeds three checks: materialise it once in the shared checkpoint directory
    checkpoint_dir(spark)
    lines = lines_2019(spark, sf_dir).checkpoint(eager=True)
    gold = (table(spark, sf_dir, "documents").select("source").distinct()
            .withColumn("gold_path", F.concat(F.lit("gold/"), F.col("source"), F.lit(".tsv"))))
    gold = rank_within(gold, [], ["source"]).withColumnRenamed("row_number", "pos").select("pos", "gold_path")
    pred = (lines.select("doc_id").distinct()
            .withColumn("pred_path", F.concat(F.lit("pred/"), F.col("doc_id"), F.lit(".tsv"))))
    pred = rank_within(pred, [], ["doc_id"]).withColumnRenamed("row_number", "pos")
    validity = file_validity(pred.select("doc_id", "pred_path"), line_violations_2019(lines))
    manifest = gold.join(pred.select("pos", "pred_path"), "pos", "full")
    return manifest_check(manifest, validity.select("pred_path", "valid"))


def conversation_stream(spark, sf_dir) -> DataFrame:
    """Conversations as one ranking file: ids restart at 1 where a conversation starts."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return c.withColumn("id", F.col("turn") + 1).withColumn("_start", (F.col("id") == 1).cast("int"))


def segment_by_restart(stream: DataFrame, order: list[str]) -> DataFrame:
    """A new document begins at every id 1 - a running count over the global order
    (gaps-and-islands); computed by the skew-safe scan since there is no partition key."""
    seg = rank_within(stream, [], order, ranks=("row_number",), sums=("_start",))
    return seg.withColumnRenamed("row_number", "gpos").withColumnRenamed("cum__start", "segment")


SEGMENT_SQL = """
c AS (SELECT conv_id, turn, turn + 1 AS id FROM conversations),
s AS (SELECT c.*, row_number() OVER (ORDER BY conv_id, turn) AS gpos,
             SUM(CASE WHEN id = 1 THEN 1 ELSE 0 END) OVER (ORDER BY conv_id, turn
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment
      FROM c)"""


@register("segment_by_restart", "WITH " + SEGMENT_SQL +
          "\nSELECT conv_id, turn, CAST(segment AS BIGINT) AS segment FROM s",
          "W5: segment number by restart of the id sequence (conversations in file order)")
def q_segment_by_restart(spark, sf_dir):
    seg = segment_by_restart(conversation_stream(spark, sf_dir), ["conv_id", "turn"])
    return seg.select("conv_id", "turn", "segment")


@register("split_output_check", "WITH " + SEGMENT_SQL + """,
p AS (SELECT segment AS doc_no, COUNT(*) AS n_produced, arg_min(id, gpos) AS first_id FROM s GROUP BY segment),
o AS (SELECT row_number() OVER (ORDER BY conv_id) AS doc_no, n_original
      FROM (SELECT conv_id, COUNT(*) AS n_original FROM conversations GROUP BY conv_id))
SELECT CAST(COALESCE(o.doc_no, p.doc_no) AS BIGINT) AS doc_no, o.n_original, p.n_produced, p.first_id,
       COALESCE(o.n_original = p.n_produced, false) AND COALESCE(p.first_id = 1, false) AS ok
FROM o FULL OUTER JOIN p ON o.doc_no = p.doc_no""",
          "V5 J6 W5: split files by restart, compare row counts with the originals, first id = 1")
def q_split_output_check(spark, sf_dir):
    seg = segment_by_restart(conversation_stream(spark, sf_dir), ["conv_id", "turn"])
    produced = seg.groupBy(F.col("segment").alias("doc_no")).agg(
        F.count(F.lit(1)).alias("n_produced"), F.min_by("id", "gpos").alias("first_id"))
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_original"))
    original = rank_within(counts, [], ["conv_id"]).select(F.col("row_number").alias("doc_no"), "n_original")
    return split_output_check(original, produced, "doc_no").select(
        "doc_no", "n_original", "n_produced", "first_id", "ok")
