"""Ranking metrics: hand-worked cases, a sequential re-computation, properties, both strategies."""

import math
import random

import pytest
from pyspark.sql import functions as F

from worthrank.functions.scalar import MAIN_THRESHOLDS
from worthrank.operators.metrics import mean_metrics, precision_curve, rank_items, ranking_metrics

SCHEMA = "topic_id string, item_id long, score double, pos long, label int"


def _doc(topic, labels, scores=None):
    scores = scores or [float(len(labels) - i) for i in range(len(labels))]
    return [(topic, i, s, i, lab) for i, (s, lab) in enumerate(zip(scores, labels))]


def _by_topic(df):
    return {r["topic_id"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("strategy", ["window", "two_level"])
def test_hand_worked_cases(spark, strategy):
    rows = (_doc("a", [1, 0, 1, 0]) + _doc("b", [0, 0, 1]) + _doc("c", [0, 0]) + _doc("d", [1, 1])
            + _doc("tie", [0, 1], scores=[0.5, 0.5]))
    m = _by_topic(ranking_metrics(spark.createDataFrame(rows, SCHEMA), ["topic_id"], strategy=strategy))
    a = m["a"]
    assert a["ap"] == pytest.approx((1 + 2 / 3) / 2)
    assert (a["rr"], a["r_prec"], a["p_1"]) == (1.0, 0.5, 1.0)
    assert a["p_3"] == pytest.approx(2 / 3) and a["p_5"] is None
    b = m["b"]
    assert b["ap"] == pytest.approx(1 / 3) and b["rr"] == pytest.approx(1 / 3) and b["r_prec"] == 0.0
    assert b["p_3"] == pytest.approx(1 / 3)
    c = m["c"]
    assert (c["ap"], c["rr"], c["r_prec"], c["p_1"], c["p_3"], c["n_rel"]) == (0.0, 0.0, 0.0, 0.0, None, 0)
    d = m["d"]
    assert (d["ap"], d["rr"], d["r_prec"], d["p_1"]) == (1.0, 1.0, 1.0, 1.0)
    t = m["tie"]  # equal scores keep file order: the positive is second
    assert (t["ap"], t["rr"], t["r_prec"], t["p_1"]) == (0.5, 0.5, 0.0, 0.0)


def _sequential(rows, thresholds=MAIN_THRESHOLDS):
    """Straightforward per-document loop, written independently of the Spark plan."""
    out = {}
    topics = sorted({r[0] for r in rows})
    for t in topics:
        doc = sorted((r for r in rows if r[0] == t), key=lambda r: (-r[2], r[3]))
        labels = [r[4] for r in doc]
        big_r = sum(1 for x in labels if x == 1)
        hits, ap, rr = 0, 0.0, 0.0
        for i, x in enumerate(labels, 1):
            if x == 1:
                hits += 1
                ap += hits / i
                if rr == 0.0:
                    rr = 1.0 / i

        def p_at(k):
            return sum(1 for x in labels[:k] if x == 1) / k

        res = {"n": len(labels), "n_rel": big_r, "ap": ap / big_r if big_r else 0.0, "rr": rr,
               "r_prec": p_at(big_r) if big_r else 0.0}
        for k in thresholds:
            res[f"p_{k}"] = p_at(k) if k <= len(labels) else None
        out[t] = res
    return out


def _random_rows(seed):
    rnd = random.Random(seed)
    rows, item = [], 0
    for t in range(12):
        n = rnd.choice([1, 2, 4, 9, 30, 70])
        kind = rnd.choice(["mixed", "none", "all"])
        for i in range(n):
            lab = {"mixed": rnd.randrange(2), "none": 0, "all": 1}[kind]
            rows.append((f"t{t}", item, float(rnd.randrange(5)), i, lab))
            item += 1
    # one hot topic
    for i in range(400):
        rows.append(("hot", item, float(rnd.randrange(40)), i, int(rnd.random() < 0.1)))
        item += 1
    return rows


@pytest.mark.parametrize("seed,strategy", [(1, "window"), (1, "two_level"), (7, "two_level"), (11, "window")])
def test_against_sequential(spark, seed, strategy):
    rows = _random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = _by_topic(ranking_metrics(df, ["topic_id"], strategy=strategy))
    want = _sequential(rows)
    assert set(got) == set(want)
    for t, w in want.items():
        for k, v in w.items():
            g = got[t][k]
            if v is None:
                assert g is None, (t, k)
            else:
                assert g == pytest.approx(v, abs=1e-12), (t, k, g, v)


def test_properties(spark):
    rows = _random_rows(3)
    df = spark.createDataFrame(rows, SCHEMA)
    base = _by_topic(ranking_metrics(df, ["topic_id"]))
    # strictly increasing transform of the scores changes nothing
    moved = _by_topic(ranking_metrics(df.withColumn("score", F.exp(F.col("score") / 7.0) * 3 + 1), ["topic_id"]))
    for t in base:
        for k in ("ap", "rr", "r_prec", "p_1", "p_5"):
            assert (base[t][k] is None and moved[t][k] is None) or base[t][k] == pytest.approx(moved[t][k])
            if base[t][k] is not None:
                assert 0.0 <= base[t][k] <= 1.0
    # a perfect ranking has MAP 1 over topics with positives
    perfect = df.withColumn("score", F.col("label").cast("double")).filter(
        F.col("topic_id").isin([t for t, m in base.items() if m["n_rel"] > 0]))
    means = mean_metrics(ranking_metrics(perfect, ["topic_id"])).first()
    assert means["map"] == pytest.approx(1.0) and means["mrr"] == pytest.approx(1.0)


def test_precision_curve_and_means(spark):
    rows = _doc("a", [1, 0, 1, 0]) + _doc("b", [0, 0, 1])
    df = spark.createDataFrame(rows, SCHEMA)
    curve = precision_curve(rank_items(df, ["topic_id"], keep=("item_id",)))
    got = sorted((r["topic_id"], r["rank"], r["cum_hits"], round(r["precision"], 6)) for r in curve.collect())
    assert got[:4] == [("a", 1, 1, 1.0), ("a", 2, 1, 0.5), ("a", 3, 2, 0.666667), ("a", 4, 2, 0.5)]
    means = mean_metrics(ranking_metrics(df, ["topic_id"])).first()
    assert means["n_docs"] == 2
    assert means["map"] == pytest.approx(((1 + 2 / 3) / 2 + 1 / 3) / 2)
    assert means["mean_p_5"] is None and math.isclose(means["mean_p_3"], (2 / 3 + 1 / 3) / 2)


def test_leaderboard_golden_divisibility():
    """Every published 2019 P@N mean is k / (7 N) for an integer k (7 documents, N as divisor)."""
    published = {1: [0.2857, 0.1429, 0.4286, 0.0], 3: [0.2381, 0.0952, 0.1905],
                 5: [0.2571, 0.2286, 0.1143], 10: [0.2286, 0.2429, 0.0857], 20: [0.1571, 0.1786, 0.0643]}
    for n, values in published.items():
        for v in values:
            k = v * 7 * n
            assert abs(k - round(k)) < 7 * n * 5e-5


def test_gold_relevant_counts_and_strict(spark):
    # a repeated positive prediction counts twice against one gold positive: AP can exceed 1
    rows = [("d", 1, 0.9, 1, 1), ("d", 1, 0.8, 2, 1), ("d", 2, 0.1, 3, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    relevant = spark.createDataFrame([("d", 1)], "topic_id string, n_rel long")
    m = ranking_metrics(df, ["topic_id"], relevant=relevant).first()
    assert m["n_rel"] == 1 and m["ap"] == pytest.approx(2.0) and m["r_prec"] == 1.0
    plain = ranking_metrics(df, ["topic_id"]).first()
    assert plain["n_rel"] == 2 and plain["ap"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        ranking_metrics(df, ["topic_id"], strict=True).first()


def test_custom_thresholds(spark):
    df = spark.createDataFrame(_doc("a", [0, 1, 1, 0, 1]), SCHEMA)
    m = ranking_metrics(df, ["topic_id"], thresholds=(2, 4, 7)).first()
    assert m["p_2"] == 0.5 and m["p_4"] == 0.5 and m["p_7"] is None
    assert "p_50" not in m.asDict()
