"""Ranking metrics (A3-A9, W1-W3, L1-L3) and classification metrics.

Definitions, per group (document / topic) with ``rank`` = position by score descending, ties in
file order, ``rel`` = label is 1, ``cum`` = relevant rows at or above the rank, ``R`` = relevant
rows in the group, ``n`` = ranked rows:

* AP    = sum over relevant rows of cum / rank, divided by R; 0.0 when R = 0
* RR    = 1 / rank of the first relevant row; 0.0 when none
* P@N   = relevant rows within the first N, divided by N; NULL when N > n
* R-Pr  = relevant rows within the first R, divided by R; 0.0 when R = 0
* means = unweighted averages over groups (NULL P@N values are skipped)

Plan: one ranking scan (``rank_within``) -> one partially aggregated ``groupBy(groups)``. R-Pr
needs R on each relevant row, which rides along as a group total of the ranking scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worthrank.functions.scalar import MAIN_THRESHOLDS, argmax2, is_positive, softmax2
from worthrank.operators.ranking import OrderSpec, rank_within


def _tie_spec(tie_cols: OrderSpec) -> list[tuple[str, str]]:
    return [(t, "asc") if isinstance(t, str) else tuple(t) for t in tie_cols]


def rank_items(df: DataFrame, groups: Sequence[str], *, score_col: str = "score",
               tie_cols: OrderSpec = ("pos",), label_col: str = "label", keep: Sequence[str] = (),
               strategy: str = "two_level", with_totals: bool = False) -> DataFrame:
    """W1 + W2: ``rank`` (stable descending score) and ``cum_hits`` per group, plus ``rel``
    (and ``tot_rel`` = R when ``with_totals``).

    Only the grouping, ordering and label columns (and ``keep``) travel through the sort.
    """
    ties = _tie_spec(tie_cols)
    cols = list(dict.fromkeys([*groups, score_col, *[t for t, _ in ties], *keep]))
    base = df.select(*cols, is_positive(label_col).cast("int").alias("rel"))
    out = rank_within(base, groups, [(score_col, "desc"), *ties], ranks=("row_number",),
                      sums=("rel",), totals=("rel",) if with_totals else (), strategy=strategy)
    return out.withColumnRenamed("row_number", "rank").withColumnRenamed("cum_rel", "cum_hits")


def precision_curve(ranked: DataFrame) -> DataFrame:
    """Precision at every rank, P@rank = cum_hits / rank."""
    return ranked.withColumn("precision", F.col("cum_hits").cast("double") / F.col("rank"))


def metrics_from_ranked(ranked: DataFrame, groups: Sequence[str],
                        thresholds: Sequence[int] = MAIN_THRESHOLDS,
                        relevant: DataFrame | None = None) -> DataFrame:
    """A3-A9 from a ranked frame (``rank``, ``cum_hits``, ``rel``): one row per group.

    ``relevant`` (``groups..., n_rel``) gives R from the gold labels - one per gold key - instead
    of counting relevant ranked rows; the two differ only when predictions repeat a key (the
    2020 scorer counts a repeated positive twice against one R, so AP can exceed 1)."""
    groups = list(groups)
    if relevant is not None:
        ranked = ranked.drop("tot_rel")
    rel = F.col("rel") == 1
    rank = F.col("rank")
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.sum("rel").cast("bigint").alias("n_rel"),
        F.sum(F.when(rel, F.col("cum_hits").cast("double") / rank)).alias("_ap_sum"),
        F.min(F.when(rel, rank)).alias("_first_hit"),
    ]
    aggs += [F.sum(F.when(rel & (rank <= n), 1).otherwise(0)).cast("bigint").alias(f"_hits_{n}")
             for n in thresholds]
    if "tot_rel" in ranked.columns:
        # R is on every row already: R-Precision hits fall out of the same aggregation
        aggs.append(F.sum(F.when(rel & (rank <= F.col("tot_rel")), 1).otherwise(0)).cast("bigint").alias("_r_hits"))
        per = ranked.groupBy(*groups).agg(*aggs)
    else:
        per = ranked.groupBy(*groups).agg(*aggs)
        if relevant is not None:
            per = (per.drop("n_rel").join(relevant.select(*groups, F.col("n_rel").cast("bigint")), groups, "left")
                   .withColumn("n_rel", F.coalesce("n_rel", F.lit(0).cast("bigint"))))
        # R-Precision: hits within the first R, from the relevant rows only.
        rel_rows = ranked.filter(rel).select(*groups, "rank")
        r_hits = (rel_rows.join(per.select(*groups, "n_rel"), groups)
                  .groupBy(*groups)
                  .agg(F.sum(F.when(F.col("rank") <= F.col("n_rel"), 1).otherwise(0)).cast("bigint").alias("_r_hits")))
        per = per.join(r_hits, groups, "left")

    out = [*groups, "n", "n_rel",
           F.when(F.col("n_rel") > 0, F.col("_ap_sum") / F.col("n_rel")).otherwise(F.lit(0.0)).alias("ap"),
           F.coalesce(F.lit(1.0) / F.col("_first_hit"), F.lit(0.0)).alias("rr"),
           F.when(F.col("n_rel") > 0, F.coalesce(F.col("_r_hits"), F.lit(0)).cast("double") / F.col("n_rel"))
            .otherwise(F.lit(0.0)).alias("r_prec")]
    out += [F.when(F.col("n") >= n, F.col(f"_hits_{n}").cast("double") / F.lit(float(n))).alias(f"p_{n}")
            for n in thresholds]
    return per.select(*out)


def ranking_metrics(df: DataFrame, groups: Sequence[str], *, score_col: str = "score",
                    tie_cols: OrderSpec = ("pos",), label_col: str = "label",
                    thresholds: Sequence[int] = MAIN_THRESHOLDS, strategy: str = "two_level",
                    relevant: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """A9 ``evaluate``: per-group n, n_rel, ap, rr, r_prec, p_<N>.

    ``strict=True`` raises where the reference's scorer fails: a document with fewer ranked lines
    than a cut-off N (P@N undefined; NULL otherwise)."""
    ranked = rank_items(df, groups, score_col=score_col, tie_cols=tie_cols, label_col=label_col,
                        strategy=strategy, with_totals=relevant is None)
    out = metrics_from_ranked(ranked, groups, thresholds, relevant)
    if strict:
        short = out.filter(F.col("n") < max(thresholds)).select(*groups, "n").first()
        if short is not None:
            raise ValueError(f"P@{max(thresholds)} undefined: {short.asDict()} has fewer ranked lines")
    return out


def mean_metrics(per_group: DataFrame, thresholds: Sequence[int] = MAIN_THRESHOLDS) -> DataFrame:
    """Macro means over groups (MAP, MRR, mean R-Pr, mean P@N); one row."""
    return per_group.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.avg("ap").alias("map"),
        F.avg("rr").alias("mrr"),
        F.avg("r_prec").alias("mean_r_prec"),
        *[F.avg(f"p_{n}").alias(f"mean_p_{n}") for n in thresholds],
    )


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """L2: first k rows per group. ``row_number <= k`` lets Spark insert a partial
    WindowGroupLimit before the shuffle, so even a hot group ships at most k rows per map task."""
    from pyspark.sql import Window

    w = Window.partitionBy(*groups).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w))
            .filter(F.col(rank_col) <= k)
            .withColumn(rank_col, F.col(rank_col).cast("bigint")))


# ------------------------------------------------------------------ classification metrics

def with_probabilities(df: DataFrame, z0: str = "z0", z1: str = "z1") -> DataFrame:
    """F7 + L4: p0, p1 from two logits and the argmax prediction (tie -> class 0)."""
    p0, p1 = softmax2(z0, z1)
    return (df.withColumn("p0", p0).withColumn("p1", p1)
            .withColumn("prediction", argmax2("p0", "p1")))


def accuracy_summary(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """A10 + A11 + the four confusion cells, one row."""
    y, p = F.col(label_col), F.col(pred_col)
    cell = lambda a, b: F.sum(F.when((y == a) & (p == b), 1).otherwise(0)).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((y == p).cast("double")).alias("accuracy"),
        F.sum(p).cast("bigint").alias("predicted_positive"),
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"),
    )


def confusion_matrix(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                     classes: Sequence[int] = (0, 1)) -> DataFrame:
    """rows = true label, columns pred_<c>; empty cells are 0."""
    out = df.groupBy(F.col(label_col).alias("label")).pivot(pred_col, list(classes)).count().na.fill(0)
    return out.select("label", *[F.col(str(c)).cast("bigint").alias(f"pred_{c}") for c in classes])


def weighted_log_loss(df: DataFrame, w0: Column, w1: Column, label_col: str = "label",
                      p0: str = "p0", p1: str = "p1") -> DataFrame:
    """Class-weighted cross-entropy sum(w_y * -ln p_y) / sum(w_y), one row."""
    y = F.col(label_col)
    w = F.when(y == 1, w1).otherwise(w0)
    p_y = F.when(y == 1, F.col(p1)).otherwise(F.col(p0))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(w * -F.ln(p_y)) / F.sum(w)).alias("log_loss"),
        F.avg(-F.ln(p_y)).alias("unweighted_log_loss"),
    )


def best_by(df: DataFrame, score_col: str, tie_col: str, groups: Sequence[str] = ()) -> DataFrame:
    """The row with the highest score, the smallest ``tie_col`` winning ties.

    ``min(struct(-score, tie, ...))`` is a partial aggregation: skew-safe and one pass.
    """
    others = [c for c in df.columns if c not in (score_col, tie_col, *groups)]
    best = F.min(F.struct((-F.col(score_col)).alias("_neg"), F.col(tie_col).alias("_tie"),
                          *[F.col(c) for c in others], F.col(score_col).alias("_score")))
    agg = df.groupBy(*groups).agg(best.alias("_b")) if groups else df.agg(best.alias("_b"))
    return agg.select(*groups, F.col("_b._tie").alias(tie_col), F.col("_b._score").alias(score_col),
                      *[F.col(f"_b.{c}").alias(c) for c in others])
