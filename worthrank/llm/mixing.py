"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents stand in a queue in a fixed shuffled order. A document's virtual finish time
is its source's words up to and including it, divided by the source's weight; the second pass of a
source follows its first. Taking documents in the order of finish times until the budget is spent
gives every source its weighted share, and what a used-up source leaves goes to the others.

No prefix sum runs over a whole source or over the whole table in one task: both are two-level,
with sums per bucket of a bounded expected number of rows, a running sum over the buckets, and a
window within each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worthrank.llm.common import WORD_GAP, materialise
from worthrank.llm.quality import SPACES


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", 0).otherwise(F.size(F.split(trimmed, WORD_GAP))).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], budget_percent: int, passes: int) -> DataFrame:
    """Water-filling over (source, source_size): adds sr (rank by code point, null last), weight, target,
    budget and level.

    A source gets weight * level, but ``passes`` times its size at most; the level is such that the
    targets sum to the budget. Sources are met by the level at which they are used up, and the sums are
    of integers, so the level is the one that repeated resharing ends at. One row per source."""
    total = F.sum("source_size").over(Window.partitionBy())
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    big = "decimal(38,0)"
    ranked = sizes.withColumn("sr", F.row_number().over(by_code))
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("sr") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = (ranked.withColumn("weight", choice.cast("long"))
            .withColumn("most", F.col("source_size") * passes)
            .withColumn("budget", (total * budget_percent / 100).cast("double")))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "sr")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("used", F.coalesce(F.sum("most").over(before), F.lit(0)))
            .withColumn("open_weight", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
            .withColumn("own_level", (F.col("budget") - F.col("used")) / F.col("open_weight")))
    open_source = (F.col("own_level") * F.col("weight") < F.col("most"))
    level = F.min(F.when(open_source, F.struct(F.col("most") / F.col("weight"), "sr", "own_level"))).over(Window.partitionBy())["own_level"]
    rows = rows.withColumn("level", level)
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("most").cast("double")))
    return rows.select("source", "source_size", "sr", "weight", target.alias("target"), "budget", "level")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget_percent: int = 150, passes: int = 2,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size (words), source_size, target (its source's), copies
    (times the mix takes it) and taken (copies * size).

    Documents without words (null or empty texts too) take up no budget and get no copies. The shuffled
    order is that of md5(id), then of the id: reruns and other partitionings agree. Rows that repeat an id
    are documents of their own. A null source is a source. Other columns are ignored."""
    sized = materialise(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
        F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit("")).alias("k")), "sized")
    buckets = max(1, -(-sized.count() // bucket_rows))
    targets = materialise(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget_percent, passes), "targets")
    summary = targets.agg(F.max("budget").alias("budget"), F.max("level").alias("level")).first()
    place = F.shiftright(F.conv(F.substring("k", 1, 8), 16, 10).cast("long") * buckets, 32)
    queued = (sized.join(targets, sized["source"].eqNullSafe(targets["source"]), "left").drop(targets["source"])
              .withColumn("bucket", F.coalesce(place, F.lit(0))))
    sums = queued.groupBy("sr", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sr").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("sr", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sr", "bucket").orderBy("k", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    queue = materialise(queued.join(bases, ["sr", "bucket"]).withColumn("upto", F.col("base") + F.sum("size").over(inside))
                        .drop("bucket", "base"), "queue")

    def key(again: Column) -> Column:
        finish = (F.col("upto") + again * F.col("source_size")) / F.col("weight")
        return F.struct(finish.alias("finish"), F.col("sr").alias("sr"), again.cast("int").alias("again"), F.col("k").alias("k"),
                        F.coalesce(F.col("doc_id"), F.lit(-1).cast("long")).alias("doc_id"))

    first_out = _first_beyond(queue, key, passes, summary["budget"], summary["level"], buckets) if summary["level"] else None
    taken = [F.lit(1)] * passes
    if first_out is not None:
        bound = F.struct(F.lit(first_out["finish"]).cast("double").alias("finish"), F.lit(first_out["sr"]).cast("int").alias("sr"),
                         F.lit(first_out["again"]).cast("int").alias("again"), F.lit(first_out["k"]).alias("k"),
                         F.lit(first_out["doc_id"]).cast("long").alias("doc_id"))
        taken = [F.when(key(F.lit(p)) < bound, 1).otherwise(0) for p in range(passes)]
    copies = F.when(F.col("size") > 0, sum(taken[1:], taken[0])).otherwise(0)
    return (queue.withColumn("copies", copies.cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
            .select("doc_id", "source", "size", "source_size", "target", "copies", "taken"))


def _first_beyond(queue: DataFrame, key, passes: int, budget: float, level: float, buckets: int):
    """The key of the first copy, in the order of keys, with which the words exceed the budget; None if
    all copies fit. Finish times are cut into ranges that hold a bounded number of copies, because all
    sources together pass words at the highest rate at the start; only the range in which the budget
    ends is sorted."""
    width = level / (4 * buckets)
    last = 16 * buckets
    copies = (queue.where("size > 0").withColumn("again", F.explode(F.array(*[F.lit(p) for p in range(passes)])))
              .select("size", key(F.col("again")).alias("key"))
              .withColumn("span", F.least(F.floor(F.col("key.finish") / width), F.lit(last)).cast("long")))
    sums = copies.groupBy("span").agg(F.sum("size").alias("words"))
    upto = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    over = (sums.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") > budget)
            .agg(F.min(F.struct("span", (F.col("upto") - F.col("words")).alias("base"))).alias("at")).first()["at"])
    if over is None:
        return None
    running = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    inside = copies.where(F.col("span") == over["span"]).withColumn("upto", F.sum("size").over(running) + over["base"])
    return inside.where(F.col("upto") > budget).agg(F.min("key").alias("key")).first()["key"]
