"""Registered preparation queries: P1, P2, F11, A1, A2, A17, J7, T1-T4, U1, U2."""

from __future__ import annotations

from pyspark.sql import functions as F

from worthrank.functions.scalar import binarize, lcg_key
from worthrank.operators.prepare import (class_weights, exact_split, poisson_resample, predefined_split, project_corpus,
                                         ratio_sample, union_corpora, weighted_resample, with_class_weight)
from worthrank.plans.ranking_queries import G1_SQL
from worthrank.plans.registry import register, round6
from worthrank.sources.testdata import labelled_documents, table

LCG_SQL = "(({x}) * 1103515245 + 12345) % 2147483648"


@register("binarize_labels", """
SELECT d.doc_id, d.source, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS label,
       CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS toxic, l.doc_id IS NOT NULL AS is_labelled
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
          "P1 P2 J7: projection and 1 -> 1 / other-or-NULL -> 0 binarisation over all documents")
def q_binarize_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    lab = table(spark, sf_dir, "labels").withColumn("_has", F.lit(True))
    j = d.join(lab, "doc_id", "left")
    return j.select("doc_id", "source", binarize("quality").alias("label"), binarize("toxic").alias("toxic"),
                    F.coalesce("_has", F.lit(False)).alias("is_labelled"))


@register("class_weights", """
SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n1,
       COUNT(*) - CAST(SUM(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n0,
       ROUND(CAST(COUNT(*) AS DOUBLE) / NULLIF(COUNT(*) - SUM(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0), 6) AS w0,
       ROUND(CAST(COUNT(*) AS DOUBLE) / NULLIF(SUM(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0), 6) AS w1
FROM labels""", "A1 A2: class counts and weights w1 = N/n1, w0 = N/(N-n1)")
def q_class_weights(spark, sf_dir):
    return round6(class_weights(table(spark, sf_dir, "labels"), "quality"))


@register("class_weighted_rows", """
WITH w AS (SELECT CAST(COUNT(*) AS DOUBLE) / NULLIF(COUNT(*) - SUM(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS w0,
                  CAST(COUNT(*) AS DOUBLE) / NULLIF(SUM(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS w1 FROM labels)
SELECT l.doc_id, l.toxic, ROUND(CASE WHEN l.toxic = 1 THEN (SELECT w1 FROM w) ELSE (SELECT w0 FROM w) END, 6) AS weight
FROM labels l""", "F11 A2: per-row class weight through a scalar subquery (no cross join)")
def q_class_weighted_rows(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return round6(with_class_weight(lab, "toxic"))


@register("corpus_profile", f"""
WITH g AS ({G1_SQL.format(label='quality')})
SELECT lang, topic_id AS source, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS n_pos,
       ROUND(CAST(SUM(label) AS DOUBLE) / COUNT(*), 6) AS rate
FROM g GROUP BY ROLLUP (lang, topic_id)""",
          "A17: labelled sentences, positives and rate per language and source with rollup totals")
def q_corpus_profile(spark, sf_dir):
    g = labelled_documents(spark, sf_dir, "quality")
    out = g.rollup("lang", F.col("topic_id").alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_pos"))
    return round6(out.withColumn("rate", F.col("n_pos").cast("double") / F.col("n")))


@register("unlabelled_rows", """
SELECT d.doc_id, d.source, CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
          "J7: left enrichment join, rows without a label object kept with NULLs (labels as DOUBLE, "
          "so a missing label reads the same - NULL/NaN - in every client)")
def q_unlabelled_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    j = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.select("doc_id", "source", F.col("quality").cast("double"), F.col("toxic").cast("double"))


@register("train_val_split", f"""
WITH r AS (SELECT doc_id, quality, row_number() OVER (ORDER BY {LCG_SQL.format(x='doc_id')}, doc_id) AS k FROM labels)
SELECT doc_id, quality, CASE WHEN k <= CEIL(0.2 * (SELECT COUNT(*) FROM labels)) THEN 'val' ELSE 'train' END AS split
FROM r""", "T1: exact-size 80/20 split in keyed pseudo-random order (ceil(0.2 N) validation rows)")
def q_train_val_split(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return exact_split(lab, "doc_id", 0.2, key=lcg_key)


SPLIT_RULES = [("test", r"^src1[5-9]$"), ("dev", r"^src1[0-4]$")]


@register("predefined_split", f"""
WITH g AS ({G1_SQL.format(label='quality')}),
s AS (SELECT g.*, CASE WHEN regexp_matches(topic_id, '^src1[5-9]$') THEN 'test'
                       WHEN regexp_matches(topic_id, '^src1[0-4]$') THEN 'dev' ELSE 'train' END AS split FROM g)
SELECT split, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS n_pos FROM s GROUP BY split""",
          "T2: split named by the source (file) of each row")
def q_predefined_split(spark, sf_dir):
    g = labelled_documents(spark, sf_dir, "quality")
    s = predefined_split(g, "topic_id", SPLIT_RULES)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_pos"))


@register("weighted_resample", f"""
WITH l AS (SELECT doc_id, quality, toxic, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS cls FROM labels),
rows AS (SELECT l.*, row_number() OVER (PARTITION BY cls ORDER BY {LCG_SQL.format(x='doc_id')}, doc_id) - 1 AS class_index
         FROM l),
sizes AS (SELECT cls, COUNT(*) AS n_cls FROM l GROUP BY cls),
d AS (SELECT doc_id AS draw_id, {LCG_SQL.format(x='doc_id')} AS u1 FROM l),
d2 AS (SELECT draw_id, u1, CASE WHEN u1 >= 1073741824 THEN 1 ELSE 0 END AS cls FROM d),
d3 AS (SELECT d2.draw_id, d2.cls, {LCG_SQL.format(x='d2.u1')} % s.n_cls AS class_index
       FROM d2 JOIN sizes s ON d2.cls = s.cls)
SELECT d3.draw_id, r.doc_id, r.quality, r.toxic
FROM d3 JOIN rows r ON d3.cls = r.cls AND d3.class_index = r.class_index""",
          "T3: N weighted draws with replacement, classes drawn 50/50, exact N")
def q_weighted_resample(spark, sf_dir):
    return weighted_resample(table(spark, sf_dir, "labels"), "quality", "doc_id", key=lcg_key)


@register("poisson_resample", f"""
WITH l AS (SELECT doc_id, quality, toxic, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS cls FROM labels),
m AS (SELECT cls, CAST(ceil(mean / 16.0) AS INTEGER) AS parts, mean / ceil(mean / 16.0) AS mean
      FROM (SELECT cls, CAST((SELECT COUNT(*) FROM l) AS DOUBLE) / (2 * COUNT(*)) AS mean FROM l GROUP BY cls)),
p AS (SELECT cls, j, SUM(exp(j * ln(mean) - mean - lgamma(j + 1))) OVER (PARTITION BY cls ORDER BY j) AS upto
      FROM (SELECT cls, mean, unnest(range(100)) AS j FROM m)),
r AS (SELECT l.*, unnest(range(1, m.parts + 1)) AS part FROM l JOIN m USING (cls)),
u AS (SELECT r.*, {LCG_SQL.format(x='doc_id * 31 + part')} / 2147483648.0 AS u FROM r),
n AS (SELECT u.doc_id, u.quality, u.toxic, u.part, COUNT(*) AS n FROM u JOIN p ON p.cls = u.cls AND p.upto <= u.u GROUP BY ALL)
SELECT doc_id, quality, toxic, CAST(part AS INTEGER) AS part, CAST(unnest(range(1, n + 1)) AS INTEGER) AS draw FROM n""",
          "T3 A1: Poisson mode: each row repeated by a count from its own key, both classes with N / 2 draws in expectation, no shuffle of rows")
def q_poisson_resample(spark, sf_dir):
    return poisson_resample(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "toxic", "doc_id",
                            uniform=lambda i, part: lcg_key(i * 31 + part).cast("double") / F.lit(2147483648.0))


@register("ratio_sample", f"""
WITH l AS (SELECT doc_id, quality, toxic, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS cls FROM labels),
r AS (SELECT l.*, row_number() OVER (PARTITION BY cls ORDER BY {LCG_SQL.format(x='doc_id')}, doc_id) - 1 AS ci FROM l)
SELECT doc_id, quality, toxic FROM r
WHERE cls = 1 OR ci < FLOOR(2.0 * (SELECT SUM(cls) FROM l))""",
          "T4: all positives plus floor(2 x positives) negatives in keyed order")
def q_ratio_sample(spark, sf_dir):
    return ratio_sample(table(spark, sf_dir, "labels"), "toxic", "doc_id", 2.0, key=lcg_key)


@register("combined_corpora", """
SELECT 'documents' AS corpus, CAST(d.source AS VARCHAR) AS doc_id, d.doc_id AS item_id, length(d.text) AS text_len,
       CAST(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS DOUBLE) AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
UNION ALL
SELECT 'conversations', CAST(conv_id AS VARCHAR), turn, length(text), CAST(NULL AS DOUBLE) FROM conversations
UNION ALL
SELECT 'benchmark', 'benchmark', item_id, length(text), CAST(NULL AS DOUBLE) FROM benchmark""",
          "U1 U2: corpora projected to one shape and concatenated by name (label DOUBLE: NULL for "
          "unlabelled corpora)")
def q_combined_corpora(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    a = project_corpus(d, "documents", F.col("source"), F.col("doc_id"), F.col("text"), F.col("quality"))
    c = table(spark, sf_dir, "conversations")
    b = project_corpus(c, "conversations", F.col("conv_id"), F.col("turn"), F.col("text"), None)
    bm = table(spark, sf_dir, "benchmark")
    e = project_corpus(bm, "benchmark", F.lit("benchmark"), F.col("item_id"), F.col("text"), None)
    u = union_corpora([a, b, e])
    return u.select("corpus", "doc_id", "item_id", F.length("text").cast("bigint").alias("text_len"),
                    F.col("label").cast("double"))
