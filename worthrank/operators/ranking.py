"""Ranking within groups: row_number / rank / dense_rank and running sums.

One plan, in built-in window and aggregate expressions, whatever the size of the groups. The rows are
range-partitioned on ``(groups, order)``, so a hot group spans many partitions and ties stay together. The
partition number becomes a column of the checkpointed frame. Ranks and running sums are computed per
``(groups, partition)``; the counts and sums of the partitions of those groups that span several, two rows a
partition at most, are prefix-summed and joined back. As the partition number is data, not a property of the
task that reads a row, the result survives ``coalesce``, ``union`` and retries.

``strategy="window"`` is the plain ``Window.partitionBy(groups)``, for callers whose groups are small by their
nature; types, NULLs and values are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worthrank.session import checkpoint_dir

RANK_KINDS = ("row_number", "rank", "dense_rank")
#: Session setting: how many range partitions to rank in. Unset, ``spark.sql.shuffle.partitions`` is the most and
#: adaptive execution merges partitions below its advisory size, so that their number follows the data.
PARTITIONS_CONF = "worthrank.rank.partitions"
PART = "_rank_part"

OrderSpec = Sequence[str | tuple[str, str]]


def _norm_order(order: OrderSpec) -> list[tuple[str, bool]]:
    out = []
    for o in order:
        if isinstance(o, str):
            out.append((o, True))
        else:
            name, direction = o
            if direction not in ("asc", "desc"):
                raise ValueError(f"direction must be 'asc' or 'desc', got {direction!r}")
            out.append((name, direction == "asc"))
    return out


def _sort_cols(groups: Sequence[str], order: list[tuple[str, bool]]) -> list[Column]:
    cols = [F.col(g).asc() for g in groups]
    cols += [F.col(n).asc() if asc else F.col(n).desc() for n, asc in order]
    return cols


def _cum_name(s: str) -> str:
    return f"cum_{s}"


def rank_within(
    df: DataFrame,
    groups: Sequence[str],
    order: OrderSpec,
    *,
    ranks: Sequence[str] = ("row_number",),
    sums: Sequence[str] = (),
    totals: Sequence[str] = (),
    strategy: str = "two_level",
    partitions: int | None = None,
) -> DataFrame:
    """Add rank columns and inclusive running sums (``cum_<col>``) within ``groups`` ordered by ``order``.

    ``order`` lists column names (ascending) or ``(name, 'asc'|'desc')`` pairs. Give a total order
    when ``row_number`` must be deterministic. Rank columns are BIGINT. ``totals`` adds whole-group
    sums (``tot_<col>``). ``partitions`` fixes the number of range partitions of the two-level plan.
    """
    groups = list(groups)
    order_n = _norm_order(order)
    for r in ranks:
        if r not in RANK_KINDS:
            raise ValueError(f"unknown rank kind {r!r}")
    if strategy == "window":
        return _ranked(df, groups, order_n, list(ranks), sums, totals)
    if strategy != "two_level":
        raise ValueError(f"unknown strategy {strategy!r}")
    return _rank_two_level(df, groups, order_n, list(ranks), list(sums), list(totals), partitions)


def _ranked(df: DataFrame, groups: Sequence[str], order_n, ranks, sums, totals) -> DataFrame:
    """Ranks, running sums and sums by plain windows over ``groups``."""
    whole = Window.partitionBy(*groups)
    w = whole.orderBy(*_sort_cols([], order_n))
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fns = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}
    return df.select("*", *[fns[r]().over(w).cast("bigint").alias(r) for r in ranks],
                     *[F.sum(s).over(frame).alias(_cum_name(s)) for s in sums],
                     *[F.sum(t).over(whole).alias(f"tot_{t}") for t in totals])


def _rank_two_level(df, groups, order_n, ranks, sums, totals, partitions) -> DataFrame:
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get(PARTITIONS_CONF, "0"))
    keys = _sort_cols(groups, order_n)
    spread = df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)
    held = spread.withColumn(PART, F.spark_partition_id()).checkpoint(eager=True)
    local = _ranked(held, [*groups, PART], order_n, ranks, sums, totals)
    if held.rdd.getNumPartitions() <= 1:  # every group is whole: nothing to add
        return local.drop(PART)

    # one row per group and partition; only groups in several partitions, at most two rows a partition, go on
    whole, before = Window.partitionBy(*groups), Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    source = local if "dense_rank" in ranks else held
    aggregates = [F.count(F.lit(1)).alias("_n")]
    if "dense_rank" in ranks:
        aggregates.append(F.max("dense_rank").alias("_d"))
    aggregates += [F.sum(c).alias(f"_s{i}") for i, c in enumerate([*sums, *totals])]
    per = source.groupBy(*groups, PART).agg(*aggregates)
    offsets = per.withColumn("_spans", F.count(F.lit(1)).over(whole)).where("_spans > 1")
    named = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    offsets = offsets.select(
        *named, F.col(PART).alias("_p"), F.sum("_n").over(before).alias("_bn"),
        *([F.sum("_d").over(before).alias("_bd")] if "dense_rank" in ranks else []),
        *[F.sum(f"_s{i}").over(before).alias(f"_b{i}") for i in range(len(sums))],
        *[F.sum(f"_s{len(sums) + i}").over(whole).alias(f"_t{i}") for i in range(len(totals))],
        F.lit(True).alias("_found"))
    on = F.col(PART) == F.col("_p")
    for i, g in enumerate(groups):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = local.join(offsets, on, "left")
    types = {f.name: f.dataType for f in local.schema.fields}

    def added(own: str, offset: str) -> Column:
        """Their sum as a window's: NULL only if both are."""
        return F.coalesce(F.col(own) + F.col(offset), F.col(own), F.col(offset)).cast(types[own]).alias(own)

    return joined.select(
        *df.columns, *[added(r, "_bd" if r == "dense_rank" else "_bn") for r in ranks],
        *[added(_cum_name(s), f"_b{i}") for i, s in enumerate(sums)],
        *[F.when(F.col("_found"), F.col(f"_t{i}")).otherwise(F.col(f"tot_{t}")).cast(types[f"tot_{t}"]).alias(f"tot_{t}") for i, t in enumerate(totals)])
