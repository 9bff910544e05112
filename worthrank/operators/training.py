"""Training of linear heads by full-batch gradient steps.

A head is a weight vector over a row's features and a constant 1. One scan of the rows serves all candidates: every task sums
each candidate's gradient and loss over its training rows and counts the validation rows that the candidate gets right; the
sums are added up a tree, and only weights and sums, which are as long as candidates times features, meet on the driver. Steps
start from zeros or from given weights, so training goes on, stage after stage, from what an earlier stage has saved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worthrank.functions.scalar import binarize
from worthrank.operators.blocks import Blocks, BlockWeights
from worthrank.session import ship_package, tasks_for

#: Tasks' sums that are added together at a time.
FAN_IN = 64


@dataclass(frozen=True)
class Candidate:
    """Settings of one fit: step width and the weight of the squared norm (without the constant's weight)."""

    rate: float
    l2: float = 0.0


@dataclass(frozen=True)
class Sums:
    """What one scan has found out about each candidate's weights."""

    gradient: np.ndarray  # candidates x (features + 1), weighted mean over the training rows
    loss: np.ndarray  # weighted mean log loss of the training rows
    val_rows: int
    val_right: np.ndarray


class Dense:
    """A batch of vectors of the same length, with a constant 1 at the end."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.x = np.ones((batch.num_rows, width))
        self.x[:, :-1] = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width - 1)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return self.x @ weights.T

    def back(self, factors: np.ndarray) -> np.ndarray:
        """The sum of the vectors times each column of factors."""
        return factors.T @ self.x


class Indexed:
    """A batch of vectors given by the numbers (``index``) and values (``features``) of their entries."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.width, self.n = width, batch.num_rows
        counts = np.diff(batch.column("features").offsets.to_numpy())
        self.row = np.repeat(np.arange(self.n), counts)
        self.at, self.value = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("index", "features"))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, weights=self.value * w[self.at], minlength=self.n) + w[-1] for w in weights], axis=1)

    def back(self, factors: np.ndarray) -> np.ndarray:
        out = np.stack([np.bincount(self.at, weights=self.value * f[self.row], minlength=self.width) for f in factors.T])
        out[:, -1] += factors.sum(axis=0)
        return out


def indexed_rows(df: DataFrame, label_col: str = "label", weight_col: str | None = None, split_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """As ``training_rows``, for rows with ``index`` and ``features`` (``features.indexed_texts``); the number of features isn't in them.
    With ``id_col`` the rows keep their ``id`` and aren't persisted: ``fit_heads`` then deals them into blocks of features."""
    val = F.lit(False) if split_col is None else F.coalesce(F.col(split_col) == "val", F.lit(False))
    weight = F.lit(1.0) if weight_col is None else F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0))
    own = [] if id_col is None else [F.col(id_col).alias("id")]
    rows = df.select(*own, "features", "index", binarize(label_col).alias("label"), weight.alias("weight"), val.alias("val")).where(F.col("val") | (F.col("weight") > 0))
    return rows if own else rows.repartition(tasks_for(rows)).persist(StorageLevel.MEMORY_AND_DISK)


def training_rows(df: DataFrame, vec_col: str, label_col: str = "label", weight_col: str | None = None, split_col: str | None = None) -> DataFrame:
    """(features, label, weight, val): what a scan reads, dealt out by the number of rows and persisted for the
    length of a fit (unpersist it then). Rows whose vector is null, holds a null or non-finite value, or is not as long as
    most vectors (the shorter length if two are as frequent) take no part; neither do training rows without a positive
    weight. Without ``split_col`` all rows are training rows."""
    v = F.col(vec_col).cast("array<double>")
    sound = v.isNotNull() & F.forall(F.coalesce(v, F.array()), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    val = F.lit(False) if split_col is None else F.coalesce(F.col(split_col) == "val", F.lit(False))
    weight = F.lit(1.0) if weight_col is None else F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0))
    rows = df.select(v.alias("features"), binarize(label_col).alias("label"), weight.alias("weight"), val.alias("val"))
    rows = rows.where(sound).where(val | (F.col("weight") > 0))
    rows = rows.where(F.size("features") == rows.select(F.mode(F.size("features"), True)).scalar())
    return rows.repartition(tasks_for(rows)).persist(StorageLevel.MEMORY_AND_DISK)


def feature_count(rows: DataFrame) -> int:
    first = rows.select(F.size("features").alias("n")).first()
    return 0 if first is None else first["n"]


SUMS_SCHEMA = "candidate int, node long, gradient binary, loss double, weight double, val_rows long, val_right long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SUMS_SCHEMA.split(", ")])


def scan(rows: DataFrame, weights: np.ndarray) -> Sums:
    """One pass over ``training_rows`` for all candidates (the rows of ``weights``, the constant's weight last)."""
    ship_package(rows.sparkSession)
    held = weights.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, width = held.shape
        gradient, loss, right = np.zeros(held.shape), np.zeros(count), np.zeros(count, np.int64)
        weight, n_val = 0.0, 0
        for batch in batches:
            x = (Indexed if "index" in batch.schema.names else Dense)(batch, width)
            y, w = batch.column("label").to_numpy().astype(float)[:, None], batch.column("weight").to_numpy()[:, None]
            val = batch.column("val").to_numpy(zero_copy_only=False).astype(bool)
            w = np.where(val[:, None], 0.0, w)
            z = x.dot(held)
            right += ((z > 0) == (y > 0))[val].sum(axis=0)
            n_val += int(val.sum())
            small = np.exp(-np.abs(z))
            p = np.where(z >= 0, 1.0, small) / (1.0 + small)
            gradient += x.back(w * (p - y))
            loss += (w * (np.log1p(small) + np.maximum(z, 0.0) - z * y)).sum(axis=0)
            weight += float(w.sum())
        node = TaskContext.get().partitionId()
        yield _batch([(c, node, gradient[c].tobytes(), loss[c], weight, n_val, int(right[c])) for c in range(count)])

    def add(met: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(g) for g in met.column("gradient").to_pylist()], axis=0)
        row = (met.column("candidate")[0].as_py(), met.column("node")[0].as_py(), total.tobytes(), *(sum(met.column(c).to_pylist()) for c in ("loss", "weight", "val_rows", "val_right")))
        return pa.Table.from_batches([_batch([row])])

    parts, nodes = rows.mapInArrow(run, SUMS_SCHEMA), rows.rdd.getNumPartitions()
    while nodes > FAN_IN:
        parts = parts.withColumn("node", F.floor(F.col("node") / FAN_IN)).groupBy("candidate", "node").applyInArrow(add, SUMS_SCHEMA)
        nodes = -(-nodes // FAN_IN)
    gradient, loss, weight = np.zeros(weights.shape), np.zeros(len(weights)), 0.0
    right, n_val = np.zeros(len(weights), np.int64), 0
    for r in sorted(parts.collect(), key=lambda r: (r.candidate, r.node)):
        gradient[r.candidate] += np.frombuffer(r.gradient)
        loss[r.candidate] += r.loss
        right[r.candidate] += r.val_right
        if r.candidate == 0:
            weight, n_val = weight + r.weight, n_val + r.val_rows
    return Sums(gradient / weight if weight else gradient, loss / weight if weight else loss * np.nan, n_val, right)


TRACE_SCHEMA = "step int, candidate int, loss double, val_acc double, gradient double"


@dataclass(frozen=True)
class Fit:
    """``weights[s]``: the candidates' weights after s steps, from the start on. ``trace``: a row of TRACE_SCHEMA per step (from
    1) and candidate: the training loss that the step starts from (A14), the validation accuracy of the weights
    after it, and the length of the objective's gradient before it. ``converged``: whether all candidates' gradients
    came below the tolerance."""

    candidates: Sequence[Candidate]
    weights: list[np.ndarray] | list[BlockWeights]
    trace: list[tuple[int, int, float, float | None, float]]
    converged: bool = False

    def close(self) -> None:
        """Give back what a fit in blocks holds for its weights."""
        if self.weights and isinstance(self.weights[0], BlockWeights):
            self.weights[0].blocks.close()

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.trace, TRACE_SCHEMA)

    def best(self) -> tuple[int, int]:
        """(step, candidate) with the highest validation accuracy, the first of equal ones; without validation rows the
        last step of the first candidate."""
        held = [(-acc, step, c) for step, c, _, acc, _ in self.trace if acc is not None]
        return min(held)[1:] if held else (len(self.weights) - 1, 0)


def fit_heads(rows: DataFrame, candidates: Sequence[Candidate], steps: int, start: np.ndarray | None = None, width: int | None = None,
              tolerance: float = 0.0) -> Fit:
    """``steps`` full-batch steps of all candidates over ``training_rows`` or ``indexed_rows`` (these with their ``width``, the
    number of features), ``steps + 1`` scans whatever the number of candidates. ``start``: weights to go on from, for
    all candidates or one row for each; zeros without. Ends early once no candidate's gradient is longer than ``tolerance``.
    Rows with an ``id`` are fit in blocks of features from zeros, for any ``width`` (``operators.blocks``): weights don't meet on the
    driver, and the fit holds frames of them."""
    if "id" in rows.columns:
        if start is not None or width is None:
            raise ValueError("blocks of features need their width and start from zeros")
        return _fit_blocks(rows, candidates, steps, width, tolerance)
    size = (feature_count(rows) if width is None else width) + 1
    begin = np.zeros(size) if start is None else np.asarray(start, float)
    now = np.broadcast_to(begin, (len(candidates), begin.shape[-1])).copy()
    if now.shape[1] != size and size > 1:
        raise ValueError(f"weights for {now.shape[1] - 1} features, rows have {size - 1}")
    rate = np.array([c.rate for c in candidates])[:, None]
    shrink = np.array([c.l2 for c in candidates])[:, None] * np.append(np.ones(now.shape[1] - 1), 0.0)
    weights, trace, converged = [now], [], False
    found = scan(rows, now)
    for step in range(1, steps + 1):
        loss, slope = found.loss, found.gradient + shrink * now
        length = np.sqrt((slope * slope).sum(axis=1))
        converged = bool((length <= tolerance).all())
        if converged:
            break
        now = now - rate * slope
        weights.append(now)
        found = scan(rows, now)
        trace += [(step, c, float(loss[c]), float(found.val_right[c]) / found.val_rows if found.val_rows else None, float(length[c])) for c in range(len(candidates))]
    return Fit(tuple(candidates), weights, trace, converged)


def _fit_blocks(rows: DataFrame, candidates: Sequence[Candidate], steps: int, width: int, tolerance: float) -> Fit:
    """``fit_heads`` over ``operators.blocks``: the same steps, one scan of the blocks for each."""
    held = Blocks(rows, width, candidates)
    rate, constant = np.array([c.rate for c in candidates], float), np.zeros(len(candidates))
    first = held.rows_after(None, None, constant, 0.0)
    total = held.added(first)[0]
    now = held.rows_after(None, None, constant, total)
    _, residual, loss, _, _ = held.added(now)
    frames, trace, converged = [BlockWeights(held, None, constant)], [], False
    for step in range(1, steps + 1):
        sums, squares = held.step(now)
        slope = residual / total if total else residual
        length = np.sqrt(squares + slope * slope)
        converged = bool((length <= tolerance).all())
        if converged:
            sums.unpersist()
            break
        constant = constant - rate * slope
        frames.append(BlockWeights(held, now, constant))
        after = held.rows_after(sums, now, constant, total)
        mean = loss / total if total else loss * np.nan
        _, residual, loss, n_val, right = held.added(after)
        sums.unpersist()
        now = after
        trace += [(step, c, float(mean[c]), float(right[c]) / n_val if n_val else None, float(length[c])) for c in range(len(candidates))]
    return Fit(tuple(candidates), frames, trace, converged)


STATE_SCHEMA = "candidate int, rate double, l2 double, step int, weights array<double>"


def state_frame(spark: SparkSession, fit: Fit, step: int | None = None) -> DataFrame:
    """The weights of all candidates after ``step`` steps (the last without) as a table."""
    step = len(fit.weights) - 1 if step is None else step
    return spark.createDataFrame([(i, c.rate, c.l2, step, w.tolist()) for i, (c, w) in enumerate(zip(fit.candidates, fit.weights[step], strict=True))], STATE_SCHEMA)


def load_state(spark: SparkSession, path: str) -> np.ndarray:
    """The weights that ``state_frame`` has written to ``path``, a row for each candidate."""
    held = spark.read.schema(STATE_SCHEMA).parquet(path).collect()
    return np.array([r.weights for r in sorted(held, key=lambda r: r.candidate)])


def train_in_stages(spark: SparkSession, stages: Sequence[tuple[str, DataFrame]], candidate: Candidate, steps: int, path: str,
                    vec_col: str, label_col: str = "label", weight_col: str | None = None, split_col: str | None = None,
                    start: np.ndarray | None = None) -> dict[str, Fit]:
    """M6: one stage after the other over (name, rows), each from the weights that the one before it has saved under
    ``path``/name, the first from ``start``. The fits by name."""
    fits: dict[str, Fit] = {}
    for name, df in stages:
        rows = training_rows(df, vec_col, label_col, weight_col, split_col)
        fits[name] = fit_heads(rows, [candidate], steps, start)
        rows.unpersist()
        state_frame(spark, fits[name]).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        start = load_state(spark, f"{path}/{name}")
    return fits
