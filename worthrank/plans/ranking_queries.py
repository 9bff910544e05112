"""Registered ranking-evaluation queries: metrics core."""

from __future__ import annotations

from pyspark.sql import functions as F

from worthrank.functions.scalar import MAIN_THRESHOLDS
from worthrank.operators.metrics import (mean_metrics, metrics_from_ranked, precision_curve,
                                         rank_items, ranking_metrics, top_k)
from worthrank.plans.registry import register, round6
from worthrank.sources.testdata import (SUPPLIER_TIE_ORDER, labelled_documents, order_rankings,
                                        supplier_rankings)

# ------------------------------------------------------------------------- oracle SQL pieces

G1_SQL = """
SELECT d.source AS topic_id, d.doc_id AS item_id, l.{label} AS label,
       CAST(d.n_chars % 97 AS DOUBLE) / 97.0 AS score, d.doc_id AS pos, d.lang AS lang
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

G2_SQL = """
SELECT o_orderpriority AS topic_id, o_orderkey AS item_id,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
       o_totalprice AS score, o_orderkey AS pos
FROM orders
"""

G5_SQL = """
SELECT l_suppkey AS topic_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       l_extendedprice AS score, l_orderkey, l_linenumber, l_partkey
FROM lineitem
"""

G1_ORDER = "score DESC, pos ASC"
G5_ORDER = "score DESC, l_orderkey ASC, l_linenumber ASC, l_partkey ASC, label ASC"


def ranked_sql(fixture: str, order: str) -> str:
    return f"""
g AS ({fixture}),
r AS (
  SELECT g.*,
         row_number() OVER (PARTITION BY topic_id ORDER BY {order}) AS rnk,
         SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER (
             PARTITION BY topic_id ORDER BY {order}
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY topic_id) AS r_tot
  FROM g)"""


def per_topic_sql(thresholds=MAIN_THRESHOLDS) -> str:
    p = ",\n  ".join(
        f"CASE WHEN COUNT(*) >= {n} THEN CAST(SUM(CASE WHEN label = 1 AND rnk <= {n} THEN 1 ELSE 0 END)"
        f" AS DOUBLE) / {n} END AS p_{n}" for n in thresholds)
    return f"""
SELECT topic_id, CAST(COUNT(*) AS BIGINT) AS n, CAST(MAX(r_tot) AS BIGINT) AS n_rel,
  CASE WHEN MAX(r_tot) > 0 THEN SUM(CASE WHEN label = 1 THEN CAST(cum AS DOUBLE) / rnk END) / MAX(r_tot)
       ELSE 0.0 END AS ap,
  COALESCE(CAST(1 AS DOUBLE) / MIN(CASE WHEN label = 1 THEN rnk END), 0.0) AS rr,
  CASE WHEN MAX(r_tot) > 0
       THEN CAST(SUM(CASE WHEN label = 1 AND rnk <= r_tot THEN 1 ELSE 0 END) AS DOUBLE) / MAX(r_tot)
       ELSE 0.0 END AS r_prec,
  {p}
FROM r GROUP BY topic_id"""


METRIC_COLS = ["n", "n_rel", "ap", "rr", "r_prec", *[f"p_{n}" for n in MAIN_THRESHOLDS]]
_R6 = lambda c: f"ROUND({c}, 6) AS {c}"
PER_TOPIC_SELECT = ", ".join(["topic_id", "n", "n_rel", *[_R6(c) for c in METRIC_COLS[2:]]])


def metrics_query_sql(fixture: str, order: str) -> str:
    return f"WITH {ranked_sql(fixture, order)},\nm AS ({per_topic_sql()})\nSELECT {PER_TOPIC_SELECT} FROM m"


def mean_query_sql(fixture: str, order: str) -> str:
    means = ", ".join([
        "CAST(COUNT(*) AS BIGINT) AS n_docs", "ROUND(AVG(ap), 6) AS map", "ROUND(AVG(rr), 6) AS mrr",
        "ROUND(AVG(r_prec), 6) AS mean_r_prec",
        *[f"ROUND(AVG(p_{n}), 6) AS mean_p_{n}" for n in MAIN_THRESHOLDS]])
    return f"WITH {ranked_sql(fixture, order)},\nm AS ({per_topic_sql()})\nSELECT {means} FROM m"


# ------------------------------------------------------------------------------- queries

@register("ranking_metrics", metrics_query_sql(G1_SQL.format(label="quality"), G1_ORDER),
          "J1 W1 W2 A3-A7 A9 P3 L1 L3 on G1 (documents x labels.quality)")
def q_ranking_metrics(spark, sf_dir):
    g1 = labelled_documents(spark, sf_dir, "quality")
    return round6(ranking_metrics(g1, ["topic_id"], tie_cols=("pos",)))


@register("ranking_metrics_sparse_positives", metrics_query_sql(G1_SQL.format(label="toxic"), G1_ORDER),
          "A4-A7 edge cases: topics without positives, fewer rows than N (G1 with labels.toxic)")
def q_ranking_metrics_sparse(spark, sf_dir):
    g1 = labelled_documents(spark, sf_dir, "toxic")
    return round6(ranking_metrics(g1, ["topic_id"], tie_cols=("pos",)))


@register("mean_metrics", mean_query_sql(G2_SQL, G1_ORDER),
          "A8 macro means (MAP, MRR, mean R-Pr, mean P@N) over G2 (orders by priority)")
def q_mean_metrics(spark, sf_dir):
    per = ranking_metrics(order_rankings(spark, sf_dir), ["topic_id"], tie_cols=("pos",))
    return round6(mean_metrics(per))


@register("order_ranking_metrics", metrics_query_sql(G2_SQL, G1_ORDER),
          "A9 per topic on G2: five large topics (a fifth of all orders each)")
def q_order_ranking_metrics(spark, sf_dir):
    return round6(ranking_metrics(order_rankings(spark, sf_dir), ["topic_id"], tie_cols=("pos",)))


@register("supplier_ranking_metrics", metrics_query_sql(G5_SQL, G5_ORDER),
          "A9 per supplier on G5 (lineitem), tie order over four columns")
def q_supplier_ranking_metrics(spark, sf_dir):
    return round6(ranking_metrics(supplier_rankings(spark, sf_dir), ["topic_id"],
                                  tie_cols=SUPPLIER_TIE_ORDER))


@register("supplier_mean_metrics", mean_query_sql(G5_SQL, G5_ORDER),
          "A8 macro means over suppliers (G5)")
def q_supplier_mean_metrics(spark, sf_dir):
    per = ranking_metrics(supplier_rankings(spark, sf_dir), ["topic_id"], tie_cols=SUPPLIER_TIE_ORDER)
    return round6(mean_metrics(per))


@register("precision_curve", f"""WITH {ranked_sql(G1_SQL.format(label='quality'), G1_ORDER)}
SELECT topic_id, item_id, CAST(rnk AS BIGINT) AS rank, CAST(cum AS BIGINT) AS cum_hits,
       ROUND(CAST(cum AS DOUBLE) / rnk, 6) AS precision
FROM r""", "W1 W2 W3: rank, cumulative hits and P@rank for every row (G1)")
def q_precision_curve(spark, sf_dir):
    g1 = labelled_documents(spark, sf_dir, "quality")
    ranked = rank_items(g1, ["topic_id"], tie_cols=("pos",), keep=("item_id",))
    return round6(precision_curve(ranked).select("topic_id", "item_id", "rank", "cum_hits", "precision"))


@register("top_k_per_topic", """WITH g AS (""" + G2_SQL + """),
r AS (SELECT g.*, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, pos ASC) AS rnk FROM g)
SELECT topic_id, CAST(rnk AS BIGINT) AS rank, item_id, score, label FROM r WHERE rnk <= 10""",
          "L1 L2: ten highest-scored orders per priority (stable descending sort)")
def q_top_k_per_topic(spark, sf_dir):
    g2 = order_rankings(spark, sf_dir)
    top = top_k(g2, ["topic_id"], [F.col("score").desc(), F.col("pos").asc()], 10)
    return top.select("topic_id", "rank", "item_id", "score", "label")


@register("first_relevant_rank", f"""WITH {ranked_sql(G2_SQL, G1_ORDER)}
SELECT topic_id, CAST(MIN(CASE WHEN label = 1 THEN rnk END) AS BIGINT) AS first_hit_rank,
       ROUND(COALESCE(CAST(1 AS DOUBLE) / MIN(CASE WHEN label = 1 THEN rnk END), 0.0), 6) AS rr
FROM r GROUP BY topic_id""", "L3 first hit (early break) and RR per topic (G2)")
def q_first_relevant_rank(spark, sf_dir):
    ranked = rank_items(order_rankings(spark, sf_dir), ["topic_id"], tie_cols=("pos",))
    first = F.min(F.when(F.col("rel") == 1, F.col("rank")))
    return round6(ranked.groupBy("topic_id").agg(first.alias("first_hit_rank"))
                  .select("topic_id", "first_hit_rank",
                          F.coalesce(F.lit(1.0) / F.col("first_hit_rank"), F.lit(0.0)).alias("rr")))


CUTOFFS_2020 = (5, 10, 15, 20, 25, 30)


def _metrics_sql_with(fixture: str, order: str, thresholds) -> str:
    cols = ["ap", "rr", "r_prec", *[f"p_{n}" for n in thresholds]]
    sel = ", ".join(["topic_id", "n", "n_rel", *[f"ROUND({c}, 6) AS {c}" for c in cols]])
    return f"WITH {ranked_sql(fixture, order)},\nm AS ({per_topic_sql(thresholds)})\nSELECT {sel} FROM m"


@register("ranking_metrics_2020_cutoffs", _metrics_sql_with(G2_SQL, G1_ORDER, CUTOFFS_2020),
          "A6 with the 2020 task's cut-offs P@5..P@30 (thresholds as a working parameter, G2)")
def q_ranking_metrics_2020_cutoffs(spark, sf_dir):
    return round6(ranking_metrics(order_rankings(spark, sf_dir), ["topic_id"], tie_cols=("pos",),
                                  thresholds=CUTOFFS_2020))


REPORT_COLS = ["ap", "rr", "r_prec", *[f"p_{n}" for n in MAIN_THRESHOLDS]]


@register("metric_report", f"""WITH {ranked_sql(G1_SQL.format(label='quality'), G1_ORDER)},
m AS ({per_topic_sql()})
SELECT CAST(topic_id AS VARCHAR) AS doc_id, {', '.join(f"printf('%.4f', {c}) AS {c}" for c in REPORT_COLS)} FROM m
UNION ALL
SELECT 'AVERAGED', {', '.join(f"printf('%.4f', AVG({c})) AS {c}" for c in REPORT_COLS)} FROM m""",
          "K7: per-document metric report with the averaged row, 4-decimal text (G1)")
def q_metric_report(spark, sf_dir):
    from worthrank.sinks.writers import metric_report

    per = ranking_metrics(labelled_documents(spark, sf_dir, "quality"), ["topic_id"], tie_cols=("pos",))
    return metric_report(per, mean_metrics(per), REPORT_COLS, doc_col="topic_id")


__all__ = ["metrics_from_ranked"]
