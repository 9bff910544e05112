"""Training-data preparation.

Scalars that every row needs (class weights, the number of validation rows) are attached with
scalar subqueries (``DataFrame.scalar()``), never with a cross join or a driver round trip.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worthrank.functions.scalar import binarize, class_weight
from worthrank.operators.ranking import rank_within


def binarize_labels(df: DataFrame, label_col: str, out: str = "label") -> DataFrame:
    """1 stays 1, anything else (NULL, 0, -1) becomes 0."""
    return df.withColumn(out, binarize(label_col))


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A1: N, n1 (label = 1) and n0, one row."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(binarize(label_col)).cast("bigint").alias("n1")).withColumn(
        "n0", F.col("n") - F.col("n1"))


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A2: w1 = N / n1 and w0 = N / (N - n1); NULL when a class is empty."""
    c = class_counts(df, label_col)
    return c.select("n", "n1", "n0",
                    F.try_divide(F.col("n").cast("double"), F.col("n0")).alias("w0"),
                    F.try_divide(F.col("n").cast("double"), F.col("n1")).alias("w1"))


def weight_columns(df: DataFrame, label_col: str = "label") -> tuple[Column, Column]:
    """(w0, w1) as Columns usable on any frame: fields of one struct-valued scalar subquery, so
    the class counts are aggregated once however often the weights are referenced."""
    w = class_weights(df, label_col).select(F.struct("w0", "w1").alias("w")).scalar()
    return w["w0"], w["w1"]


def with_class_weight(df: DataFrame, label_col: str = "label", out: str = "weight") -> DataFrame:
    """per-row class weight from the whole frame's class balance."""
    w0, w1 = weight_columns(df, label_col)
    return df.withColumn(out, class_weight(label_col, w0, w1))


#: Keys of the sampling operators lie in [0, KEY_RANGE).
KEY_RANGE = 1 << 31
KeyFn = Callable[[Column | str], Column]


def seeded_key(seed: int) -> KeyFn:
    """A pseudo-random number in [0, KEY_RANGE) from a seed and a value."""
    return lambda c: F.pmod(F.xxhash64(F.lit(seed), F.col(c) if isinstance(c, str) else c), F.lit(KEY_RANGE))


def exact_split(df: DataFrame, id_col: str, val_fraction: float = 0.2, key: KeyFn | None = None, seed: int = 42,
                buckets: int = 1 << 16) -> DataFrame:
    """An exact-size unstratified split. Rows are ordered by a keyed pseudo-random number
    (ties by id); the first ``ceil(val_fraction * N)`` are ``val``, the rest ``train``.

    Only keys and ids are sorted, and of them only the bucket of keys in which the boundary lies (a histogram
    of at most ``buckets`` rows finds it). The boundary is one row; the split compares each row with it, so
    no text is shuffled. Ids must be unique and not null for an exact size. ``key`` replaces the seeded key."""
    keyed = (key or seeded_key(seed))(id_col).cast("bigint")
    narrow = df.select(keyed.alias("_key"), F.col(id_col).alias("_id"))
    bucket = F.floor(F.col("_key") * buckets / KEY_RANGE).cast("int")
    counts = sorted((r["b"], r["n"]) for r in narrow.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect() if r["b"] is not None)
    left = math.ceil(round(val_fraction * sum(n for _, n in counts), 9))
    if left <= 0:
        return df.withColumn("split", F.lit("train"))
    for at, n in counts:
        if n >= left:
            break
        left -= n
    inside = narrow.where(bucket == at).withColumn("_n", F.row_number().over(Window.orderBy("_key", "_id"))).where(F.col("_n") == left)
    last = inside.select("_key", "_id").first()
    in_val = (keyed < last["_key"]) | ((keyed == last["_key"]) & (F.col(id_col) <= F.lit(last["_id"])))
    return df.withColumn("split", F.when(in_val, F.lit("val")).otherwise(F.lit("train")))


def hash_split(df: DataFrame, id_col: str, val_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """T1 fast mode: ``val`` when a keyed hash of the id falls below the fraction. Narrow (no sort,
    no shuffle) and deterministic; the validation share is ``val_fraction`` in expectation rather
    than exactly ``ceil(val_fraction * N)``."""
    u = (F.xxhash64(F.lit(seed), F.col(id_col)) % F.lit(1_000_000_007)).cast("double")
    u = F.abs(u) / F.lit(1_000_000_007.0)
    return df.withColumn("split", F.when(u < F.lit(val_fraction), F.lit("val")).otherwise(F.lit("train")))


def predefined_split(df: DataFrame, path_col: str, rules: Sequence[tuple[str, str]],
                     default: str = "train") -> DataFrame:
    """Split named by the source path; ``rules`` are ``(split, regex)`` tried in order."""
    expr = None
    for name, pattern in rules:
        cond = F.col(path_col).rlike(pattern)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = F.lit(default) if expr is None else expr.otherwise(F.lit(default))
    return df.withColumn("split", expr)


def number_within_class(df: DataFrame, label_col: str, id_col: str, strategy: str = "two_level",
                        key: KeyFn | None = None, seed: int = 42) -> DataFrame:
    """0-based index of each row inside its class, in keyed pseudo-random order (ties by id).
    Two classes mean two huge groups, which the two-level ranking spreads over many tasks."""
    keyed = df.withColumn("_key", (key or seeded_key(seed))(id_col))
    ranked = rank_within(keyed, [label_col], ["_key", id_col], strategy=strategy)
    return ranked.withColumn("class_index", F.col("row_number") - 1).drop("_key", "row_number")


def weighted_resample(df: DataFrame, label_col: str, id_col: str, strategy: str = "two_level",
                      key: KeyFn | None = None, seed: int = 42) -> DataFrame:
    """N draws with replacement, P(row) proportional to its class weight N / n_class, so each
    class is drawn with probability 1/2 and uniformly within the class.

    The draw table has one draw per input row (draw_id = that row's id), so it grows with the
    data; each draw's class and index come from the keyed generator, then an equi-join on
    ``(class, index)`` fetches the drawn row. A small class is the hot key of that join; AQE's
    skew-join handling splits it. Draws of an empty class find no row (weights undefined).
    """
    bins = binarize(label_col)
    rows = number_within_class(df.withColumn("_cls", bins), "_cls", id_col, strategy=strategy, key=key, seed=seed)
    draw = key or seeded_key(seed + 1)  # another stream of numbers than the one that numbers the rows
    sizes = df.groupBy(bins.alias("_cls")).agg(F.count(F.lit(1)).alias("_n_cls"))
    draws = df.select(F.col(id_col).alias("draw_id"), draw(id_col).alias("_u1"))
    draws = draws.withColumn("_cls", F.when(F.col("_u1") >= F.lit(KEY_RANGE // 2), 1).otherwise(0))
    # two rows at most (one per class): a proven bound for the broadcast
    draws = draws.join(F.broadcast(sizes), "_cls")
    # a key given (one that SQL can compute) is drawn from again; else 64 bits of the draw's own id reach rows of any number
    place = draw(F.col("_u1")) if key else F.pmod(F.xxhash64(F.lit(seed + 2), "draw_id"), F.col("_n_cls"))
    draws = draws.withColumn("class_index", place % F.col("_n_cls"))
    return (draws.join(rows, ["_cls", "class_index"])
            .select("draw_id", *[c for c in df.columns]))


#: The mean of one Poisson count; larger means are sums of several counts.
POISSON_MEAN = 16.0


def poisson_cdf(mean: float) -> list[float]:
    """P(X <= j) from j = 0 on, as far as a double can tell it from 1."""
    term, cdf = math.exp(-mean), [math.exp(-mean)]
    while term > 1e-18 or len(cdf) <= mean:
        term *= mean / len(cdf)
        cdf.append(cdf[-1] + term)
    return cdf


def poisson_resample(df: DataFrame, label_col: str, id_col: str, uniform: Callable[[Column, Column], Column] | None = None,
                     seed: int = 42) -> DataFrame:
    """T3 without a shuffle: every row is repeated Poisson(N / (2 n_class)) times, so that each class has N / 2 draws in
    expectation, independent of each other. Adds ``part`` and ``draw``, which together number the copies of a row.

    The two class sizes are the only aggregate and all that the driver sees. A count comes from ``uniform(id, part)``, a
    number in [0, 1) (a seeded hash without), by the inverse distribution function, so reruns and retries agree and rows stay
    where they are. A mean above ``POISSON_MEAN`` is cut into equal parts that are counted apart, so the work follows
    the copies that a rare class gets. A class without rows has no copies."""
    uniform = uniform or (lambda i, part: F.pmod(F.xxhash64(F.lit(seed), i, part), F.lit(1 << 52)) / F.lit(float(1 << 52)))
    sizes = class_counts(df, label_col).first()
    own = binarize(label_col)
    parts, cdf = F.lit(0), F.array().cast("array<double>")
    for value, count in ((0, sizes["n0"]), (1, sizes["n1"])):
        if count:
            mean = sizes["n"] / (2 * count)
            n = math.ceil(mean / POISSON_MEAN)
            parts = F.when(own == value, F.lit(n)).otherwise(parts)
            cdf = F.when(own == value, F.lit(poisson_cdf(mean / n))).otherwise(cdf)
    out = df.withColumn("_cdf", cdf).withColumn("part", F.explode(F.sequence(F.lit(1), parts)))
    out = out.withColumn("_u", uniform(F.col(id_col), F.col("part")))
    out = out.withColumn("_n", F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))).where("_n > 0")
    return out.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*df.columns, "part", "draw")


def ratio_sample(df: DataFrame, label_col: str, id_col: str, ratio: float,
                 strategy: str = "two_level", key: KeyFn | None = None, seed: int = 42) -> DataFrame:
    """T4: keep every positive and the first ``floor(ratio * n1)`` negatives in keyed order."""
    bins = binarize(label_col)
    n_keep = F.floor(F.lit(ratio) * df.select(F.sum(bins)).scalar())
    numbered = number_within_class(df.withColumn("_cls", bins), "_cls", id_col, strategy=strategy, key=key, seed=seed)
    keep = (F.col("_cls") == 1) | (F.col("class_index") < n_keep)
    return numbered.filter(keep).drop("_cls", "class_index")


def dedupe_last(df: DataFrame, keys: Sequence[str], pos_cols: Sequence[str],
                value_cols: Sequence[str]) -> DataFrame:
    """One row per key, the last by position winning (dict assignment semantics).

    ``max(struct(pos..., values...))`` is a partial aggregation: a hot key is reduced map-side.
    """
    keys = list(keys)
    s = F.struct(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(pos_cols)],
                 *[F.col(c) for c in value_cols])
    return (df.groupBy(*keys).agg(F.max(s).alias("_last"))
            .select(*keys, *[F.col(f"_last._p{i}").alias(c) for i, c in enumerate(pos_cols)],
                    *[F.col(f"_last.{c}").alias(c) for c in value_cols]))


def project_corpus(df: DataFrame, corpus: str, doc_id: Column, item_id: Column, text: Column,
                   label: Column | None) -> DataFrame:
    """U2 input: the common shape ``(corpus, doc_id, item_id, text, label)``."""
    return df.select(F.lit(corpus).alias("corpus"), doc_id.cast("string").alias("doc_id"),
                     item_id.cast("bigint").alias("item_id"), text.cast("string").alias("text"),
                     (binarize(label) if label is not None else F.lit(None).cast("int")).alias("label"))


def union_corpora(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate corpora by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
