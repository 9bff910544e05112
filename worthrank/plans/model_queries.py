"""Registered classification, scalar-function and encoding queries:
A10-A15, L4, F5-F10, F12, F13, T5-T7, S2, M1, W6, K6, L5."""

from __future__ import annotations

from pyspark.sql import functions as F

from worthrank.functions.scalar import (binarize, fixed, hms, lcg_key, margin, round_half_even,
                                        softmax2, unit_interval, vector_mean)
from worthrank.operators.encode import (apply_linear_head, build_vocabulary, centroid_head, class_centroids, encode,
                                        truncate_and_pad, word_count_expr)
from worthrank.operators.metrics import (accuracy_summary, best_by, confusion_matrix, mean_metrics,
                                         ranking_metrics, weighted_log_loss, with_probabilities)
from worthrank.operators.prepare import weight_columns
from worthrank.operators.ranking import rank_within
from worthrank.plans.ranking_queries import G5_ORDER, G5_SQL, mean_query_sql, per_topic_sql, ranked_sql
from worthrank.plans.registry import register, round6
from worthrank.sources.testdata import (SUPPLIER_TIE_ORDER, event_predictions, labelled_documents,
                                        supplier_rankings, table)

G3_SQL = """
e AS (SELECT event_id, ts, user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
             CAST(0.0 AS DOUBLE) AS z0, (value - 250.0) / 50.0 AS z1 FROM events),
x AS (SELECT e.*, exp(z0 - greatest(z0, z1)) AS e0, exp(z1 - greatest(z0, z1)) AS e1 FROM e),
p AS (SELECT x.*, e0 / (e0 + e1) AS p0, e1 / (e0 + e1) AS p1 FROM x),
q AS (SELECT p.*, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS prediction FROM p)"""


@register("accuracy_confusion", "WITH " + G3_SQL + """
SELECT COUNT(*) AS n, ROUND(AVG(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       CAST(SUM(prediction) AS BIGINT) AS predicted_positive,
       CAST(SUM(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       CAST(SUM(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(SUM(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(SUM(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
FROM q""", "A10 A11 L4 F7: softmax, argmax (tie -> 0), accuracy, predicted positives, confusion cells (G3)")
def q_accuracy_confusion(spark, sf_dir):
    return round6(accuracy_summary(with_probabilities(event_predictions(spark, sf_dir))))


@register("accuracy_by_user", "WITH " + G3_SQL + """
SELECT user_id, COUNT(*) AS n, ROUND(AVG(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       CAST(SUM(prediction) AS BIGINT) AS predicted_positive, CAST(SUM(label) AS BIGINT) AS positives
FROM q GROUP BY user_id""", "A10 A11 per topic (G3 topic = user): accuracy and predicted positives")
def q_accuracy_by_user(spark, sf_dir):
    p = with_probabilities(event_predictions(spark, sf_dir))
    out = p.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        F.sum("prediction").cast("bigint").alias("predicted_positive"),
        F.sum("label").cast("bigint").alias("positives"))
    return round6(out)


@register("confusion_matrix", "WITH " + G3_SQL + """
SELECT label, CAST(SUM(CASE WHEN prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pred_0,
       CAST(SUM(CASE WHEN prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pred_1
FROM q GROUP BY label""", "A12: pivoted confusion matrix, rows true label, zero cells kept (G3)")
def q_confusion_matrix(spark, sf_dir):
    return confusion_matrix(with_probabilities(event_predictions(spark, sf_dir)))


@register("weighted_log_loss", "WITH " + G3_SQL + """,
w AS (SELECT CAST(COUNT(*) AS DOUBLE) / NULLIF(COUNT(*) - SUM(label), 0) AS w0,
             CAST(COUNT(*) AS DOUBLE) / NULLIF(SUM(label), 0) AS w1 FROM q),
r AS (SELECT q.label, CASE WHEN q.label = 1 THEN (SELECT w1 FROM w) ELSE (SELECT w0 FROM w) END AS wy,
             CASE WHEN q.label = 1 THEN q.p1 ELSE q.p0 END AS py FROM q)
SELECT COUNT(*) AS n, ROUND(SUM(wy * -ln(py)) / SUM(wy), 6) AS log_loss,
       ROUND(AVG(-ln(py)), 6) AS unweighted_log_loss FROM r""",
          "A13 A2 F11: class-weighted cross-entropy with weights from the class balance (G3)")
def q_weighted_log_loss(spark, sf_dir):
    p = with_probabilities(event_predictions(spark, sf_dir))
    w0, w1 = weight_columns(p, "label")
    return round6(weighted_log_loss(p, w0, w1))


@register("best_epoch", "WITH " + G3_SQL + """,
d AS (SELECT CAST(date_diff('day', (SELECT MIN(CAST(ts AS DATE)) FROM q), CAST(ts AS DATE)) + 1 AS BIGINT) AS epoch,
             label, prediction FROM q),
a AS (SELECT epoch, AVG(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS val_acc, COUNT(*) AS n
      FROM d GROUP BY epoch),
r AS (SELECT a.*, row_number() OVER (ORDER BY val_acc DESC, epoch ASC) AS k FROM a)
SELECT epoch, ROUND(val_acc, 6) AS val_acc, n FROM r WHERE k = 1""",
          "A15 A10 A14: validation accuracy per epoch (event day), best epoch with first-wins ties")
def q_best_epoch(spark, sf_dir):
    p = with_probabilities(event_predictions(spark, sf_dir)).withColumn("day", F.to_date("ts"))
    first_day = p.select(F.min("day")).scalar()
    per = (p.withColumn("epoch", (F.datediff("day", first_day) + 1).cast("bigint"))
           .groupBy("epoch").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("val_acc"),
                                 F.count(F.lit(1)).alias("n")))
    return round6(best_by(per, "val_acc", "epoch").select("epoch", "val_acc", "n"))


@register("margin_score", """
WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS z0, CAST(embedding[2] AS DOUBLE) AS z1 FROM embeddings),
x AS (SELECT vec_id, exp(z0 - greatest(z0, z1)) AS e0, exp(z1 - greatest(z0, z1)) AS e1 FROM e),
p AS (SELECT vec_id, e0 / (e0 + e1) AS p0, e1 / (e0 + e1) AS p1 FROM x)
SELECT vec_id, ROUND(p1, 6) AS p1, ROUND(p1 - p0, 6) AS score, printf('%.5f', round_even(p1 - p0, 5)) AS score_text
FROM p""", "F5-F8: softmax of two logits, score p1 - p0, half-even rounding and %.5f text (embeddings)")
def q_margin_score(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    p0, p1 = softmax2(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"))
    s = e.select("vec_id", p0.alias("p0"), p1.alias("p1"))
    s = s.withColumn("score", margin("p0", "p1"))
    return round6(s.select("vec_id", "p1", "score", fixed(round_half_even("score", 5), 5).alias("score_text")))


CENTROID_SQL = """
e AS (SELECT vec_id, label, CASE WHEN label = 1 THEN 1 ELSE 0 END AS cls, embedding FROM embeddings),
x AS (SELECT vec_id, label, cls, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS dim FROM e)"""


@register("linear_head_score", "WITH " + CENTROID_SQL + """,
c AS (SELECT dim, AVG(CASE WHEN cls = 1 THEN CAST(v AS DOUBLE) END) AS m1,
             AVG(CASE WHEN cls = 0 THEN CAST(v AS DOUBLE) END) AS m0 FROM x GROUP BY dim),
w AS (SELECT dim, m1 - m0 AS w, (m1 + m0) / 2 AS mid FROM c),
b AS (SELECT -SUM(w * mid) AS b FROM w),
z AS (SELECT x.vec_id, x.cls, SUM(CAST(x.v AS DOUBLE) * w.w) AS dotp FROM x JOIN w ON x.dim = w.dim
      GROUP BY x.vec_id, x.cls)
SELECT vec_id, cls AS label, ROUND(dotp + (SELECT b FROM b), 6) AS z,
       CASE WHEN dotp + (SELECT b FROM b) > 0 THEN 1 ELSE 0 END AS prediction
FROM z""", "F9 T7: linear head z = w.x + b with w, b learned from class centroids (embeddings)")
def q_linear_head_score(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    z = apply_linear_head(e, centroid_head(e, "label")).select("vec_id", binarize("label").alias("label"), "z")
    return round6(z.withColumn("prediction", F.when(F.col("z") > 0, 1).otherwise(0)))


@register("vector_mean", "WITH " + CENTROID_SQL + """,
c AS (SELECT label, dim, AVG(CAST(v AS DOUBLE)) AS m FROM x GROUP BY label, dim),
f AS (SELECT x.vec_id, (CAST(x.v AS DOUBLE) + c.m) / 2 AS fv FROM x JOIN c ON x.label = c.label AND x.dim = c.dim)
SELECT vec_id, ROUND(SUM(fv), 6) AS fused_sum, ROUND(sqrt(SUM(fv * fv)), 6) AS fused_norm, COUNT(*) AS dim
FROM f GROUP BY vec_id""", "F10: element-wise mean of each vector and its class centroid")
def q_vector_mean(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    cent = class_centroids(e, "embedding", "label")
    fused = e.join(cent, "label").select("vec_id", vector_mean("embedding", "centroid").alias("fused"))
    return round6(fused.select(
        "vec_id",
        F.aggregate("fused", F.lit(0.0), lambda a, x: a + x).alias("fused_sum"),
        F.sqrt(F.aggregate("fused", F.lit(0.0), lambda a, x: a + x * x)).alias("fused_norm"),
        F.size("fused").cast("bigint").alias("dim")))


@register("encode_pad", r"""
WITH t AS (SELECT conv_id, turn, text,
                  list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS toks
           FROM conversations),
x AS (SELECT conv_id, turn, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM t),
v AS (SELECT tok, row_number() OVER (ORDER BY cnt DESC, tok ASC) AS id
      FROM (SELECT tok, COUNT(*) AS cnt FROM x GROUP BY tok)),
e AS (SELECT x.conv_id, x.turn, x.pos, v.id FROM x JOIN v ON x.tok = v.tok),
s AS (SELECT conv_id, turn, COUNT(*) AS n_tokens, arg_min(id, pos) AS first_id,
             SUM(CASE WHEN pos <= 512 THEN id ELSE 0 END) AS id_sum, SUM(CASE WHEN pos <= 512 THEN id * pos ELSE 0 END) AS id_pos_sum, LEAST(COUNT(*), 512) AS kept
      FROM e GROUP BY conv_id, turn),
m AS (SELECT MAX(COALESCE(s.kept, 0)) AS pad_len FROM t LEFT JOIN s ON t.conv_id = s.conv_id AND t.turn = s.turn)
SELECT t.conv_id, t.turn,
       CAST(CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN 0
            ELSE len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) END AS INTEGER) AS n_words,
       CAST(COALESCE(s.n_tokens, 0) AS INTEGER) AS n_tokens, s.first_id,
       CAST(COALESCE(s.id_sum, 0) AS BIGINT) AS id_sum, CAST(COALESCE(s.id_pos_sum, 0) AS BIGINT) AS id_pos_sum,
       CAST((SELECT pad_len FROM m) AS INTEGER) AS pad_len,
       CAST(COALESCE(s.kept, 0) AS INTEGER) AS mask_sum
FROM t LEFT JOIN s ON t.conv_id = s.conv_id AND t.turn = s.turn""",
          "T5 T6 F13: corpus vocabulary, ids per text, truncation to 512, padding to the longest, "
          "attention mask, word counts (conversations)")
def q_encode_pad(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    vocab = build_vocabulary(c, "text")
    enc = encode(c, ["conv_id", "turn"], "text", vocab)
    padded = truncate_and_pad(enc, 512)
    out = padded.select(
        "conv_id", "turn", F.size("ids").alias("n_tokens"), F.get("ids", 0).alias("first_id"),
        F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"),
        F.aggregate(F.transform("input_ids", lambda x, i: x * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_pos_sum"),
        "pad_len", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))
    words = c.select("conv_id", "turn", word_count_expr("text").alias("n_words"))
    return words.join(out, ["conv_id", "turn"]).select(
        "conv_id", "turn", "n_words", "n_tokens", "first_id", "id_sum", "id_pos_sum", "pad_len", "mask_sum")


@register("documents_as_sequences", """
SELECT conv_id, COUNT(*) AS n_turns, MIN(turn) AS first_turn, MAX(turn) AS last_turn,
       arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role,
       CAST(SUM(length(text)) AS BIGINT) AS n_chars, (MAX(turn) - MIN(turn) + 1) = COUNT(*) AS contiguous
FROM conversations GROUP BY conv_id""",
          "S2: per-document sequence view (ordered members, first/last, contiguity) without "
          "collecting a whole document into one array")
def q_documents_as_sequences(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
        F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"),
        F.sum(F.length("text")).cast("bigint").alias("n_chars"),
        ((F.max("turn") - F.min("turn") + 1) == F.count(F.lit(1))).alias("contiguous"))


RANDOM_G1_SQL = """
SELECT d.source AS topic_id, d.doc_id AS item_id, l.quality AS label,
       CAST(((d.doc_id * 1103515245 + 12345) % 2147483648) AS DOUBLE) / 2147483648.0 AS score, d.doc_id AS pos
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


@register("random_baseline", mean_query_sql(RANDOM_G1_SQL, "score DESC, pos ASC"),
          "M1: keyed pseudo-random scores in [0, 1) evaluated like any run (mean metrics, G1)")
def q_random_baseline(spark, sf_dir):
    g1 = labelled_documents(spark, sf_dir, "quality").withColumn("score", unit_interval(lcg_key("item_id")))
    return round6(mean_metrics(ranking_metrics(g1, ["topic_id"], tie_cols=("pos",))))


LEADER_METRICS = ("ap", "rr", "r_prec", "p_10")


@register("leaderboard", f"""WITH {ranked_sql(G5_SQL, G5_ORDER)},
m AS ({per_topic_sql()}),
rm AS (SELECT topic_id, {', '.join(f'ROUND({c}, 6) AS {c}' for c in LEADER_METRICS)} FROM m)
SELECT topic_id, {', '.join(f'{c}, CAST(dense_rank() OVER (ORDER BY {c} DESC NULLS LAST) AS BIGINT) AS rank_{c}'
                            for c in LEADER_METRICS)}
FROM rm""", "W6: runs (suppliers) ranked per metric with dense_rank, ties share a place")
def q_leaderboard(spark, sf_dir):
    per = round6(ranking_metrics(supplier_rankings(spark, sf_dir), ["topic_id"], tie_cols=SUPPLIER_TIE_ORDER))
    # one row per run and metric, ranked by metric in one pass; NULL metrics are ranked last, as a row of their own
    long = per.select("topic_id", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in LEADER_METRICS])).alias("m")).select("topic_id", "m.*")
    ranked = rank_within(long, ["metric"], [("value", "desc")], ranks=("dense_rank",))
    wide = ranked.groupBy("topic_id").agg(*[x for c in LEADER_METRICS for x in (
        F.max(F.when(F.col("metric") == c, F.col("value"))).alias(c), F.max(F.when(F.col("metric") == c, F.col("dense_rank"))).alias(f"rank_{c}"))])
    return wide


@register("run_log_newest_first", """
WITH s AS (SELECT event_id, event_type AS phase, CAST(round_even(value, 0) AS BIGINT) AS secs, ts FROM events),
f AS (SELECT event_id, phase, ts, CAST(floor(secs / 86400.0) AS BIGINT) AS days,
             secs - CAST(floor(secs / 86400.0) AS BIGINT) * 86400 AS rest FROM s)
SELECT event_id, phase,
       CASE WHEN days = 0 THEN printf('%d:%02d:%02d', rest // 3600, (rest % 3600) // 60, rest % 60)
            ELSE printf('%d %s, %d:%02d:%02d', days, CASE WHEN abs(days) = 1 THEN 'day' ELSE 'days' END,
                        rest // 3600, (rest % 3600) // 60, rest % 60) END AS elapsed,
       CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS BIGINT) AS newest_rank
FROM f""", "K6 L5 F12: run log read newest first with h:mm:ss elapsed time (events as runs)")
def q_run_log(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("phase"), "ts",
                                              hms("value").alias("elapsed"))
    ranked = rank_within(e, [], [("ts", "desc"), ("event_id", "desc")])
    return ranked.select("event_id", "phase", "elapsed", F.col("row_number").alias("newest_rank"))


__all__ = ["G5_SQL"]
