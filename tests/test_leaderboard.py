"""W6 against the published 2019 leaderboard, and MAP against Spark's own RankingEvaluator."""

import random

import pytest
from pyspark.ml.evaluation import RankingEvaluator
from pyspark.sql import functions as F

from worthrank.operators.metrics import mean_metrics, ranking_metrics
from worthrank.operators.ranking import rank_within

METRICS = ["map", "rr", "r_p", "p_1", "p_3", "p_5", "p_10", "p_20", "p_50"]

# The published primary-run results of the 2019 task, each metric followed by the
# published place of the run in that metric's column (MAP, RR, R-P, P@1, P@3, P@5, P@10, P@20, P@50).
PUBLISHED = [
    ("Copenhagen", [(.1660, 1), (.4176, 3), (.1387, 4), (.2857, 2), (.2381, 1), (.2571, 1), (.2286, 2), (.1571, 2), (.1229, 2)]),
    ("TheEarthIsFlat", [(.1597, 2), (.1953, 11), (.2052, 1), (.0000, 4), (.0952, 3), (.2286, 2), (.2143, 3), (.1857, 1), (.1457, 1)]),
    ("IPIPAN", [(.1332, 3), (.2864, 6), (.1481, 2), (.1429, 3), (.0952, 3), (.1429, 5), (.1714, 5), (.1500, 3), (.1171, 3)]),
    ("Terrier", [(.1263, 4), (.3253, 5), (.1088, 8), (.2857, 2), (.2381, 1), (.2000, 3), (.2000, 4), (.1286, 6), (.0914, 7)]),
    ("UAICS", [(.1234, 5), (.4650, 1), (.1460, 3), (.4286, 1), (.2381, 1), (.2286, 2), (.2429, 1), (.1429, 4), (.0943, 6)]),
    ("Factify", [(.1210, 6), (.2285, 8), (.1292, 5), (.1429, 3), (.0952, 3), (.1143, 6), (.1429, 6), (.1429, 4), (.1086, 4)]),
    ("JUNLP", [(.1162, 7), (.4419, 2), (.1128, 7), (.2857, 2), (.1905, 2), (.1714, 4), (.1714, 5), (.1286, 6), (.1000, 5)]),
    ("nlpir01", [(.1000, 8), (.2840, 7), (.1063, 9), (.1429, 3), (.2381, 1), (.1714, 4), (.1000, 8), (.1214, 7), (.0943, 6)]),
    ("TOBB ETU", [(.0884, 9), (.2028, 10), (.1150, 6), (.0000, 4), (.0952, 3), (.1429, 5), (.1286, 7), (.1357, 5), (.0829, 8)]),
    ("IIT (ISM) Dhanbad, India", [(.0835, 10), (.2238, 9), (.0714, 11), (.0000, 4), (.1905, 2), (.1143, 6), (.0857, 9), (.0857, 9), (.0771, 9)]),
    ("é proibido cochilar", [(.0796, 11), (.3514, 4), (.0886, 10), (.1429, 3), (.2381, 1), (.1429, 5), (.1286, 7), (.1071, 8), (.0714, 10)]),
    ("Fire", [(.0528, 12), (.1365, 12), (.0570, 12), (.0000, 4), (.0476, 4), (.0571, 7), (.0429, 10), (.0500, 10), (.0543, 11)]),
]


@pytest.mark.parametrize("strategy", ["window", "two_level"])
def test_dense_rank_reproduces_published_places(spark, strategy):
    rows = [(team, *[v for v, _ in cells]) for team, cells in PUBLISHED]
    df = spark.createDataFrame(rows, "team string, " + ", ".join(f"{m} double" for m in METRICS))
    for i, m in enumerate(METRICS):
        ranked = rank_within(df.select("team", m), [], [(m, "desc")], ranks=("dense_rank",), strategy=strategy)
        got = {r["team"]: r["dense_rank"] for r in ranked.collect()}
        want = {team: cells[i][1] for team, cells in PUBLISHED}
        assert got == want, m


def test_map_agrees_with_ranking_evaluator(spark):
    rnd = random.Random(5)
    rows = []
    for t in range(15):
        for i in range(rnd.randrange(3, 40)):
            rows.append((f"t{t}", t * 1000 + i, rnd.random(), i, int(rnd.random() < 0.2)))
    df = spark.createDataFrame(rows, "topic_id string, item_id long, score double, pos long, label int")
    ours = mean_metrics(ranking_metrics(df, ["topic_id"])).first()["map"]
    # the evaluator takes one row per topic: items in ranked order, and the relevant items
    lists = (df.groupBy("topic_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pos", "item_id"))),
                    lambda x: x["item_id"].cast("double")).alias("prediction"),
        F.collect_list(F.when(F.col("label") == 1, F.col("item_id").cast("double"))).alias("label")))
    theirs = RankingEvaluator(metricName="meanAveragePrecision").evaluate(lists)
    assert ours == pytest.approx(theirs, abs=1e-12)
