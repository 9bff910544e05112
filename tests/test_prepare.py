"""Label preparation, weights, splits and sampling."""

import math

import pytest
from pyspark.sql import functions as F

from worthrank.functions.scalar import binarize
from worthrank.operators.prepare import (class_weights, dedupe_last, exact_split, predefined_split,
                                         ratio_sample, seeded_key, weighted_resample, with_class_weight)


def _labels(spark, n, n_pos):
    return spark.createDataFrame([(i, 1 if i < n_pos else 0) for i in range(n)], "id long, label int")


def test_binarize_keeps_only_exact_one(spark):
    df = spark.createDataFrame([(1,), (0,), (-1,), (None,), (2,)], "v int")
    assert [r[0] for r in df.select(binarize("v")).collect()] == [1, 0, 0, 0, 0]


def test_class_weights_bundled_training_balance(spark):
    # 1,386 training lines with 72 check-worthy ones
    w = class_weights(_labels(spark, 1386, 72)).first()
    assert (w["n"], w["n1"], w["n0"]) == (1386, 72, 1314)
    assert w["w1"] == pytest.approx(19.25) and round(w["w0"], 6) == 1.054795
    empty = class_weights(_labels(spark, 10, 0)).first()
    assert empty["w1"] is None and empty["w0"] == 1.0
    rows = with_class_weight(_labels(spark, 4, 1)).collect()
    assert sorted(r["weight"] for r in rows) == pytest.approx([4 / 3, 4 / 3, 4 / 3, 4.0])


@pytest.mark.parametrize("buckets", [1, 7, 1 << 16])
def test_exact_split_sizes(spark, buckets):
    s = exact_split(_labels(spark, 1386, 72), "id", 0.2, buckets=buckets)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"val": 278, "train": 1108}
    val = lambda f: sorted(r["id"] for r in f.filter("split = 'val'").collect())
    assert val(s) == val(exact_split(_labels(spark, 1386, 72).repartition(9), "id", 0.2))
    assert val(s) != val(exact_split(_labels(spark, 1386, 72), "id", 0.2, seed=43))
    assert {r["split"] for r in exact_split(_labels(spark, 10, 2), "id", 0.0).collect()} == {"train"}


def test_ids_far_apart_get_different_keys(spark):
    df = spark.range(2000).select((F.col("id") * 2**31).alias("id"))
    key = seeded_key(1)("id")
    assert df.select(key.alias("k")).distinct().count() > 1990
    a, b = (df.select(seeded_key(s)("id").alias("k")).collect() for s in (1, 2))
    assert a != b


def test_predefined_split(spark):
    df = spark.createDataFrame([("data/training/a.tsv",), ("data/dev/b.tsv",), ("data/test/c.tsv",)], "p string")
    out = [r["split"] for r in predefined_split(df, "p", [("dev", "/dev/"), ("test", "/test")]).collect()]
    assert out == ["train", "dev", "test"]


@pytest.mark.parametrize("strategy", ["window", "two_level"])
def test_weighted_resample(spark, strategy):
    df = _labels(spark, 2000, 100)
    draws = weighted_resample(df, "label", "id", strategy=strategy)
    assert draws.count() == 2000  # exactly N draws
    pos = draws.filter(F.col("label") == 1).count()
    assert abs(pos - 1000) < 4 * math.sqrt(2000 * 0.25)  # classes drawn 50/50
    # with replacement: positives repeat, every draw is a real row
    assert draws.select("id").distinct().count() < 2000
    assert draws.join(df, ["id", "label"], "left_anti").count() == 0


def test_ratio_sample(spark):
    out = ratio_sample(_labels(spark, 100, 10), "label", "id", 2.5)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {1: 10, 0: 25}


def test_dedupe_last_wins(spark):
    df = spark.createDataFrame([("k", 1, 0), ("k", 3, 1), ("k", 2, 0), ("j", 1, 1)], "key string, pos int, label int")
    got = {r["key"]: (r["pos"], r["label"]) for r in dedupe_last(df, ["key"], ["pos"], ["label"]).collect()}
    assert got == {"k": (3, 1), "j": (1, 1)}


def test_hash_split_is_narrow_and_close_to_the_fraction(spark):
    from worthrank.operators.prepare import hash_split

    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    s = hash_split(df, "doc_id", 0.2)
    n_val = s.filter("split = 'val'").count()
    assert abs(n_val - 4000) < 4 * (20000 * 0.2 * 0.8) ** 0.5
    assert "Exchange" not in s._jdf.queryExecution().executedPlan().toString()
    again = hash_split(df, "doc_id", 0.2).filter("split = 'val'").count()
    assert again == n_val


def test_poisson_resample_balances_classes_without_a_shuffle(spark):
    from worthrank.operators.prepare import poisson_cdf, poisson_resample

    assert poisson_cdf(0.5)[:2] == pytest.approx([0.6065306597, 0.9097959895])
    assert poisson_cdf(16.0)[-1] == pytest.approx(1.0, abs=1e-12) and poisson_cdf(0.0) == [1.0, 1.0][:len(poisson_cdf(0.0))]
    n, positives = 20000, 40
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") < positives, 1).when(F.col("id") % 2 == 0, None).otherwise(0).alias("label"), F.lit("x").alias("part"))
    df = df.drop("part")
    out = poisson_resample(df, "label", "id", seed=5)
    by = {r["cls"]: r["count"] for r in out.groupBy((F.coalesce("label", F.lit(0)) == 1).alias("cls")).count().collect()}
    for cls in (True, False):  # N / 2 each, within 5 standard deviations
        assert abs(by[cls] - n / 2) < 5 * (n / 2) ** 0.5
    assert out.where("id < 40").groupBy("id").count().agg(F.min("count")).first()[0] > 150  # a mean of 250 a row
    assert out.select("id", "part", "draw").distinct().count() == out.count()
    assert sorted(map(tuple, poisson_resample(df.repartition(7), "label", "id", seed=5).collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    only = poisson_resample(df.where("label = 1"), "label", "id")
    assert only.count() > 0 and poisson_resample(df.limit(0), "label", "id").count() == 0
