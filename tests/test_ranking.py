import random

import pytest
from pyspark.sql import functions as F

from worthrank.operators.ranking import rank_within


def _rows(seed, n_groups, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # one hot group holding about a third of the rows
        g = "hot" if rnd.random() < 0.35 else f"g{rnd.randrange(n_groups)}"
        score = rnd.choice([None, float(rnd.randrange(6)), float(rnd.randrange(6))])
        rows.append((g, score, i, rnd.randrange(2)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_range_equals_window(spark, seed):
    df = spark.createDataFrame(_rows(seed, 7, 3000), "g string, score double, pos long, rel int")
    df = df.repartition(13)
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kw = dict(ranks=("row_number", "rank", "dense_rank"), sums=("rel",))
        w = rank_within(df, ["g"], [("score", "desc"), ("pos", "asc")], strategy="window", **kw)
        r = rank_within(df, ["g"], [("score", "desc"), ("pos", "asc")], strategy="two_level", **kw)
        cols = ["g", "pos", "row_number", "rank", "dense_rank", "cum_rel"]
        a = sorted(tuple(x) for x in w.select(*cols).collect())
        b = sorted(tuple(x) for x in r.select(*cols).collect())
        assert a == b
        # ties only on score: rank/dense_rank must also agree
        kw2 = dict(ranks=("rank", "dense_rank"), sums=("rel",))
        w2 = rank_within(df, ["g"], [("score", "desc")], strategy="window", **kw2)
        r2 = rank_within(df, ["g"], [("score", "desc")], strategy="two_level", **kw2)
        a2 = sorted(repr(tuple(x)) for x in w2.select("g", "score", "rank", "dense_rank").collect())
        b2 = sorted(repr(tuple(x)) for x in r2.select("g", "score", "rank", "dense_rank").collect())
        assert a2 == b2
        # no groups at all: a global numbering
        w3 = rank_within(df, [], [("pos", "asc")], strategy="window", sums=("rel",))
        r3 = rank_within(df, [], [("pos", "asc")], strategy="two_level", sums=("rel",))
        assert sorted(tuple(x) for x in w3.select("pos", "row_number", "cum_rel").collect()) == \
            sorted(tuple(x) for x in r3.select("pos", "row_number", "cum_rel").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_range_strategy_spreads_a_hot_group(spark):
    """A group holding 90% of the rows is scanned by many tasks, not one (the window plan would
    put it in a single partition); its numbering is still one consecutive sequence. AQE only
    merges range partitions below its advisory size, so coalescing is off for this tiny input."""
    df = spark.range(50000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
        .otherwise(F.lit("hot")).alias("g"),
        (F.col("id") * 7919 % 50000).alias("k"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = rank_within(df, ["g"], ["k"], strategy="two_level")
        hot = out.filter(F.col("g") == "hot")
        parts = hot.select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts > 4
        r = hot.agg(F.min("row_number"), F.max("row_number"), F.count(F.lit(1)), F.countDistinct("row_number")).first()
        assert (r[0], r[1], r[2], r[3]) == (1, 45000, 45000, 45000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_range_carries_state_across_arrow_batches(spark):
    """Partitions larger than one Arrow batch: the scan state must carry from batch to batch."""
    df = spark.createDataFrame(_rows(9, 3, 1500), "g string, score double, pos long, rel int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        kw = dict(ranks=("row_number", "rank", "dense_rank"), sums=("rel",))
        w = rank_within(df, ["g"], [("score", "desc")], strategy="window", **kw)
        r = rank_within(df, ["g"], [("score", "desc")], strategy="two_level", **kw)
        cols = ["g", "score", "rank", "dense_rank"]
        assert sorted(repr(tuple(x)) for x in w.select(*cols).collect()) == \
            sorted(repr(tuple(x)) for x in r.select(*cols).collect())
        # row_number / running sums with a total order
        w2 = rank_within(df, ["g"], [("score", "desc"), "pos"], strategy="window", sums=("rel",))
        r2 = rank_within(df, ["g"], [("score", "desc"), "pos"], strategy="two_level", sums=("rel",))
        c2 = ["g", "pos", "row_number", "cum_rel"]
        assert sorted(tuple(x) for x in w2.select(*c2).collect()) == sorted(tuple(x) for x in r2.select(*c2).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("strategy", ["window", "two_level"])
def test_group_totals(spark, strategy):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("b", 1, 1), ("b", 2, 1)], "g string, pos long, rel int")
    got = {(r["g"], r["pos"]): r["tot_rel"] for r in
           rank_within(df, ["g"], ["pos"], sums=("rel",), totals=("rel",), strategy=strategy).collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("b", 1): 2, ("b", 2): 2}
    glob = rank_within(df, [], ["g", "pos"], totals=("rel",), strategy=strategy).select("tot_rel").distinct().collect()
    assert [r[0] for r in glob] == [3]


def _skewed(spark, n=4000):
    """Nullable BIGINT above 2^53, DECIMAL, leading NULL sums, ties and a hot group."""
    i = F.col("id")
    return spark.range(n, numPartitions=7).select(
        F.when(i % 3 == 0, "hot").when(i % 50 == 1, None).otherwise(F.concat(F.lit("g"), i % 40)).alias("g"), (i * 7919 % 997).alias("k"), i.alias("pos"),
        F.when(i % 5 > 0, i + 2**60 + 1).alias("big"), F.when(i % 997 > 100, (i % 13).cast("decimal(20,2)")).alias("amount"),
        F.when(i * 7919 % 997 > 300, (i % 4)).alias("late"))


@pytest.mark.parametrize("groups", [["g"], []])
@pytest.mark.parametrize("n", [1, 3, 50])
def test_two_levels_equal_the_plain_window(spark, groups, n):
    df = _skewed(spark)
    order = [("k", "desc"), "pos"]
    kw = dict(ranks=("row_number", "rank", "dense_rank"), sums=("amount", "late"), totals=("amount", "late"))
    plain = rank_within(df, groups, order, strategy="window", **kw)
    two = rank_within(df, groups, order, partitions=n, **kw)
    assert two.dtypes == plain.dtypes
    expected = sorted(map(repr, plain.collect()))
    for moved in (two, two.coalesce(1), two.coalesce(3), two.where("pos % 2 = 0").union(two.where("pos % 2 = 1")), two.repartition(5)):
        assert sorted(map(repr, moved.collect())) == expected
    tied = dict(ranks=("rank", "dense_rank"))
    assert sorted(map(repr, rank_within(df, groups, ["k"], partitions=n, **tied).collect())) == \
        sorted(map(repr, rank_within(df, groups, ["k"], strategy="window", **tied).collect()))


def test_empty_frame(spark):
    assert rank_within(_skewed(spark).limit(0), ["g"], ["pos"], sums=("late",), totals=("late",)).collect() == []
