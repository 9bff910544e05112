"""Registered training queries (M5, M6, A14, A15, K5) over the supplied embeddings. The oracles take the same steps in
recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from worthrank.functions.scalar import lcg_key
from worthrank.operators.features import feature_index, indexed_texts
from worthrank.operators.models import with_weights
from worthrank.operators.prepare import exact_split
from worthrank.operators.training import Candidate, fit_heads, indexed_rows, state_frame, train_in_stages, training_rows
from worthrank.plans.prepare_queries import LCG_SQL
from worthrank.plans.registry import register, round6
from worthrank.session import scratch_path
from worthrank.sinks.model_store import ModelStore
from worthrank.sources.testdata import table

CANDIDATES = (Candidate(0.5), Candidate(0.5, 0.1), Candidate(2.0), Candidate(2.0, 0.1), Candidate(0.05))
STEPS = 6


def split_embeddings(spark, sf_dir):
    """The embeddings with a 0/1 label and their split; the even ids stand for one corpus, the odd for another."""
    e = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("label") == 1, 1).otherwise(0))
    return exact_split(e, "vec_id", 0.2, key=lcg_key).withColumn("corpus", F.when(F.col("vec_id") % 2 == 0, "first").otherwise("second"))


def weighted(rows):
    """Class weights by the training rows; a validation row's weight is never read."""
    return with_weights(rows.where("split = 'train'"), "label").unionByName(rows.where("split = 'val'").withColumn("weight", F.lit(0.0)))


def steps_sql(candidates, steps, stages=1):
    """CTEs ``e`` (the rows) and ``t(step, candidate, w, loss)``: the weights after each step from zeros, and the loss the step
    started from. With two stages the first ``steps`` are over one corpus, the others over the other."""
    rows = ", ".join(f"({i}, CAST({c.rate} AS DOUBLE), CAST({c.l2} AS DOUBLE))" for i, c in enumerate(candidates))
    stage = "CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 1 END" if stages == 2 else "0"
    return f"""
s AS (SELECT vec_id, CASE WHEN label = 1 THEN 1 ELSE 0 END AS y, {stage} AS stage, list_append(CAST(embedding AS DOUBLE[]), 1.0) AS x,
             row_number() OVER (ORDER BY {LCG_SQL.format(x='vec_id')}, vec_id) > CEIL(0.2 * COUNT(*) OVER ()) AS train FROM embeddings),
e AS (SELECT *, CAST(COUNT(*) OVER (PARTITION BY stage, train) AS DOUBLE) / COUNT(*) OVER (PARTITION BY stage, train, y) AS wt FROM s),
u AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM e WHERE train),
n AS (SELECT MAX(len(x)) AS dims FROM e),
c(candidate, rate, l2) AS (VALUES {rows}),
t AS (
  SELECT 0 AS step, candidate, rate, l2, dims, list_transform(range(dims), lambda i: CAST(0 AS DOUBLE)) AS w, CAST(NULL AS DOUBLE) AS loss FROM c, n
  UNION ALL
  SELECT step + 1, candidate, rate, l2, dims,
         list(w[d] - rate * (g / ws + CASE WHEN d < dims THEN l2 * w[d] ELSE 0 END) ORDER BY d), any_value(ls / ws)
  FROM (SELECT z.step, z.candidate, z.rate, z.l2, z.dims, any_value(z.w) AS w, u.d, SUM(wt * (1 / (1 + exp(-zz)) - y) * u.v) AS g, SUM(wt) AS ws,
               SUM(wt * (ln(1 + exp(-abs(zz))) + greatest(zz, 0) - zz * y)) AS ls
        FROM (SELECT t.*, e.vec_id, e.y, e.wt, list_dot_product(e.x, t.w) AS zz FROM t JOIN e ON e.train AND e.stage = t.step // {steps}) z
        JOIN u USING (vec_id) GROUP BY z.step, z.candidate, z.rate, z.l2, z.dims, u.d)
  GROUP BY step, candidate, rate, l2, dims),
a AS (SELECT t.step, t.candidate, t.rate, t.l2, any_value(t.loss) AS loss,
             AVG(CASE WHEN (list_dot_product(e.x, t.w) > 0) = (e.y = 1) THEN 1.0 ELSE 0.0 END) AS val_acc
      FROM t JOIN e ON NOT e.train WHERE t.step > 0 GROUP BY t.step, t.candidate, t.rate, t.l2)"""


@register("staged_warm_start", f"""
WITH RECURSIVE {steps_sql([Candidate(0.5, 0.01)], STEPS, stages=2)}
SELECT CASE WHEN step = {STEPS} THEN 'first' ELSE 'second' END AS stage, CAST(unnest(range(len(w))) AS INTEGER) AS dim, ROUND(unnest(w), 6) AS weight
FROM t WHERE step IN ({STEPS}, {2 * STEPS})""",
          "M6 S13: training in stages over two corpora, the second from the weights that the first has saved (full-batch steps)")
def q_staged_warm_start(spark, sf_dir):
    e = split_embeddings(spark, sf_dir).where("split = 'train'")
    path = scratch_path(spark, "stages")
    stages = [(name, with_weights(e.where(F.col("corpus") == name), "label")) for name in ("first", "second")]
    train_in_stages(spark, stages, Candidate(0.5, 0.01), STEPS, path, "embedding", weight_col="weight")
    saved = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("stage"), F.posexplode("weights").alias("dim", "weight")) for name, _ in stages]
    return round6(saved[0].unionByName(saved[1]))


@register("candidate_steps", f"""
WITH RECURSIVE {steps_sql(CANDIDATES, STEPS)}
SELECT CAST(step AS INTEGER) AS step, CAST(candidate AS INTEGER) AS candidate, ROUND(loss, 6) AS loss, ROUND(val_acc, 6) AS val_acc,
       row_number() OVER (ORDER BY val_acc DESC, step, candidate) = 1 AS best
FROM a""", "M5 A14 A15: all candidate settings fitted together, one scan a step; training loss and validation accuracy per step, the "
          "highest accuracy wins, the first of equal ones")
def q_candidate_steps(spark, sf_dir):
    rows = training_rows(weighted(split_embeddings(spark, sf_dir)), "embedding", weight_col="weight", split_col="split")
    fit = fit_heads(rows, CANDIDATES, STEPS)
    rows.unpersist()
    step, candidate = fit.best()
    return round6(fit.table(spark).drop("gradient").withColumn("best", (F.col("step") == step) & (F.col("candidate") == candidate)))


@register("saved_when_better", f"""
WITH RECURSIVE {steps_sql([Candidate(2.0, 0.1)], 2 * STEPS)},
b AS (SELECT *, val_acc > coalesce(MAX(val_acc) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS saved FROM a)
SELECT CAST(step AS INTEGER) AS step, ROUND(loss, 6) AS loss, ROUND(AVG(loss) OVER (ORDER BY step), 6) AS mean_loss, ROUND(val_acc, 6) AS val_acc, saved,
       CAST(MAX(CASE WHEN saved THEN step END) OVER (ORDER BY step) AS INTEGER) AS saved_step
FROM b""", "A14 K5 S13: the training loss of every step and its running mean; weights are committed only when validation "
          "accuracy rises, and read back from the store after each step")
def q_saved_when_better(spark, sf_dir):
    rows = training_rows(weighted(split_embeddings(spark, sf_dir)), "embedding", weight_col="weight", split_col="split")
    fit = fit_heads(rows, [Candidate(2.0, 0.1)], 2 * STEPS)
    rows.unpersist()
    store = ModelStore(spark, scratch_path(spark, "model-store"))
    out, losses = [], []
    for step, _, loss, acc, _ in fit.trace:
        saved = store.offer(f"step-{step}", acc, lambda p, s=step: state_frame(spark, fit, s).coalesce(1).write.mode("overwrite").parquet(p))
        losses.append(loss)
        held = spark.read.parquet(store.current_path()).first()
        out.append((step, loss, sum(losses) / len(losses), acc, saved, held["step"]))
    return round6(spark.createDataFrame(out, "step int, loss double, mean_loss double, val_acc double, saved boolean, saved_step int"))


#: Words of a text and its runs of two words, per (doc_id, term), for the rows of ``texts``.
TERMS_SQL = """
words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM texts),
tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM (
         SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM words)
       GROUP BY doc_id, term)"""


@register("ngram_feature_index", "WITH texts AS (SELECT doc_id, text FROM documents)," + TERMS_SQL + """
SELECT term, docs, row_number() OVER (ORDER BY docs DESC, term) AS feature
FROM (SELECT term, COUNT(*) AS docs FROM tf GROUP BY term) WHERE docs >= 2""",
          "M2: every word and word pair that two documents hold gets a feature of its own, numbered by document frequency")
def q_ngram_feature_index(spark, sf_dir):
    return feature_index(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", min_docs=2)


NGRAM = Candidate(0.02, 0.01)


@register("ngram_indexed_fit", f"""
WITH RECURSIVE g AS (SELECT d.doc_id, d.text, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS y FROM documents d JOIN labels l USING (doc_id)),
texts AS (SELECT *, row_number() OVER (ORDER BY {LCG_SQL.format(x='doc_id')}, doc_id) > CEIL(0.2 * COUNT(*) OVER ()) AS train FROM g),
{TERMS_SQL},
e AS (SELECT doc_id, y, train, CAST(COUNT(*) OVER (PARTITION BY train) AS DOUBLE) / COUNT(*) OVER (PARTITION BY train, y) AS wt FROM texts),
n AS (SELECT COUNT(*) AS docs, SUM(wt) AS wt FROM e WHERE train),
idx AS (SELECT term, docs, row_number() OVER (ORDER BY docs DESC, term) AS d
        FROM (SELECT term, COUNT(*) AS docs FROM tf JOIN e USING (doc_id) WHERE train GROUP BY term) WHERE docs >= 2),
u AS (SELECT tf.doc_id, idx.d, tf.tf * ln((n.docs + 1.0) / (idx.docs + 1.0)) AS v FROM tf JOIN idx USING (term), n
      UNION ALL SELECT doc_id, 0, 1.0 FROM e),
t AS (
  SELECT 0 AS step, d, CAST(0 AS DOUBLE) AS w, CAST(NULL AS DOUBLE) AS loss, CAST(NULL AS DOUBLE) AS slope FROM (SELECT d FROM idx UNION ALL SELECT 0)
  UNION ALL
  SELECT step + 1, d, w - {NGRAM.rate} * own, ls, own FROM (
    SELECT t.step, t.d, t.w, gs.ls, gs.g + CASE WHEN t.d > 0 THEN {NGRAM.l2} * t.w ELSE 0 END AS own
    FROM t JOIN (
      SELECT u.d, SUM(z.r * u.v) / any_value(n.wt) AS g, any_value(z.ls) / any_value(n.wt) AS ls
      FROM (SELECT doc_id, wt * (1 / (1 + exp(-zz)) - y) AS r, SUM(wt * (ln(1 + exp(-abs(zz))) + greatest(zz, 0) - zz * y)) OVER () AS ls
            FROM (SELECT u.doc_id, SUM(u.v * t.w) AS zz FROM u JOIN t USING (d) WHERE t.step < {STEPS} GROUP BY u.doc_id) JOIN e USING (doc_id) WHERE train) z
      JOIN u USING (doc_id), n GROUP BY u.d) gs USING (d))),
a AS (SELECT step, AVG(CASE WHEN (zz > 0) = (y = 1) THEN 1.0 ELSE 0.0 END) AS val_acc
      FROM (SELECT t.step, u.doc_id, SUM(u.v * t.w) AS zz FROM t JOIN u USING (d) GROUP BY ALL) JOIN e USING (doc_id) WHERE NOT train GROUP BY step)
SELECT CAST(step AS INTEGER) AS step, ROUND(any_value(loss), 6) AS loss, ROUND(any_value(val_acc), 6) AS val_acc, ROUND(sqrt(SUM(slope * slope)), 6) AS gradient,
       COUNT(*) - 1 AS features, sqrt(SUM(slope * slope)) <= 0.001 AS converged
FROM t JOIN a USING (step) WHERE step > 0 GROUP BY step""",
          "M2 A14: the n-gram baseline over exact features, one per distinct term; loss, gradient length and convergence of every step")
def q_ngram_indexed_fit(spark, sf_dir):
    g = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    split = exact_split(g.withColumn("label", F.when(F.col("label") == 1, 1).otherwise(0)), "doc_id", 0.2, key=lcg_key)
    train = split.where("split = 'train'")
    index = feature_index(train, "doc_id", "text", min_docs=2)
    width = index.count()
    rows = indexed_rows(indexed_texts(weighted(split), "doc_id", "text", index, train.count()), weight_col="weight", split_col="split", id_col="doc_id")
    fit = fit_heads(rows, [NGRAM], STEPS, width=width)
    fit.close()
    out = fit.table(spark).drop("candidate").withColumn("features", F.lit(width).cast("bigint"))
    return round6(out.withColumn("converged", F.col("gradient") <= 0.001))
