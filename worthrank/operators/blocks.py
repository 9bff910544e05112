"""Fits over indexed rows whose features are too many for one machine's memory.

Full-batch steps from zeros keep the weights a combination of the rows: after any number of steps they are X' u, where u
has one value a row. So weights and gradients, which are as long as the features, never meet anywhere: the entries of X lie
in blocks of features, a block's weights are made of u where the block lies, and what moves between the steps has one value
a row for each candidate: the sums of entries times weights, and u with the residuals, which a broadcast takes to the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthrank.session import checkpoint_dir, ship_package

#: Features a block has at most.
BLOCK = 1 << 18
#: Rows that are numbered together at most, and bytes of sums that a task holds.
GROUP, HELD_BYTES = 1 << 13, 1 << 26
#: The entries of a group of rows (``d``) in a block (``f``), by feature; for f = -1 the rows' labels, validation marks and weights.
CELLS = pa.schema([("f", pa.int32()), ("d", pa.int64()), ("n", pa.int32()), ("feature", pa.binary()), ("row", pa.binary()), ("value", pa.binary())])
CELLS_SCHEMA = "f int, d long, n int, feature binary, row binary, value binary"
ROWS_SCHEMA = "d long, u binary, r binary, total double, residual array<double>, loss array<double>, val_rows long, val_right array<long>"


def _packed(x: np.ndarray) -> bytes:
    """The size of an array in bytes, and the array compressed."""
    return len(x.tobytes()).to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unpacked(held: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(held[8:], int.from_bytes(held[:8], "little"), codec="zstd", asbytes=True), kind)


def cells_of(rows: DataFrame, blocks: int) -> DataFrame:
    """The cells of ``rows``, unsorted. Feature i is number i div blocks of block i mod blocks, so frequent features, which have the
    small numbers, are dealt to all blocks."""
    ship_package(rows.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = TaskContext.get().partitionId() << 32
        for whole in batches:
            for start in range(0, whole.num_rows, GROUP):
                batch = whole.slice(start, GROUP)
                n, d = batch.num_rows, d + 1
                y, val, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "val", "weight"))
                yield pa.RecordBatch.from_pylist([{"f": -1, "d": d, "n": n, "feature": _packed(y.astype(np.int8)), "row": _packed(val.astype(np.int8)), "value": _packed(w.astype(float))}], CELLS)
                row = np.repeat(np.arange(n, dtype=np.uint16), np.diff(batch.column("features").offsets.to_numpy()))
                at, value = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("index", "features"))
                f, feature = at % blocks, at // blocks
                order = np.argsort(f * BLOCK + feature, kind="stable")
                f, feature, row, value = f[order], feature[order].astype(np.int32), row[order], value[order].astype(float)
                ends = np.append(np.flatnonzero(np.diff(f)) + 1, len(f)) if len(f) else []
                begin = 0
                for end in ends:
                    cut = slice(begin, end)
                    yield pa.RecordBatch.from_pylist([{"f": int(f[begin]), "d": d, "n": n, "feature": _packed(np.diff(feature[cut], prepend=np.int32(0))), "row": _packed(row[cut]), "value": _packed(value[cut])}], CELLS)
                    begin = end

    return rows.select("features", "index", "label", "weight", "val").mapInArrow(cut, CELLS_SCHEMA)


def _by_block(batches: Iterator[pa.RecordBatch], candidates: int) -> Iterator[tuple[int, list]]:
    """(block, its cells) from rows that are sorted by block."""
    now, held = None, []
    for batch in batches:
        for x in batch.to_pylist():
            if x["f"] != now and held:
                yield now, held
                held = []
            now = x["f"]
            held.append((x["d"], x["n"], x["feature"], x["row"], x["value"], *(np.frombuffer(x[c]).reshape(candidates, -1) for c in ("u", "r"))))
    if held:
        yield now, held


def _entries(cell: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(_unpacked(cell[2], np.int32)), _unpacked(cell[3], np.uint16), _unpacked(cell[4], float)


def _block_weights(cells: list, rate: np.ndarray, shrink: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's weights after a step, and the gradient that it took."""
    w, g = np.zeros((2, len(rate), BLOCK))
    for cell in cells:
        feature, row, value = _entries(cell)
        for c in range(len(rate)):
            for out, by in ((w, cell[5]), (g, cell[6])):
                sums = np.bincount(feature, weights=value * by[c][row])
                out[c, : len(sums)] += sums
    slope = g + shrink[:, None] * w
    return w - rate[:, None] * slope, slope


@dataclass(frozen=True)
class BlockWeights:
    """The weights after a step: those of the features as a frame, ``constant`` for each candidate. To be read before the fit is closed."""

    blocks: Blocks
    rows: DataFrame | None  # of the step before; None: zeros
    constant: np.ndarray

    def frame(self) -> DataFrame:
        """(candidate, index, weight) of the features that a row has; all others' are zero, as before the first step."""
        return self.blocks.weights(self.rows) if self.rows is not None else self.blocks.cells.sparkSession.createDataFrame([], "candidate int, index long, weight double")


class Blocks:
    """``rows`` (``indexed_rows`` with ids) in blocks of features, persisted until ``close``."""

    def __init__(self, rows: DataFrame, width: int, candidates: Sequence):
        self.rate, self.shrink = np.array([c.rate for c in candidates], float), np.array([c.l2 for c in candidates], float)
        self.count, self.blocks = len(candidates), max(1, -(-width // BLOCK))
        checkpoint_dir(rows.sparkSession)
        # a row's number is its place in its partition, so that a task that is run again must find the same order
        cells = cells_of(rows.sortWithinPartitions("id"), self.blocks)
        tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, self.blocks // 8)
        self.cells = cells.repartition(tasks, "f").sortWithinPartitions("f", "d").persist(StorageLevel.MEMORY_AND_DISK)
        self.labels = self.cells.where("f = -1").select("d", "n", "feature", "row", "value").checkpoint(eager=True)

    def close(self) -> None:
        self.cells.unpersist()

    def rows_after(self, sums: DataFrame | None, before: DataFrame | None, constant: np.ndarray, total: float) -> DataFrame:
        """ROWS_SCHEMA: a row per group with u, the residuals by ``total`` (the weight of all training rows) and what is to be added up. ``sums``
        are the groups' sums of entries times weights, ``before`` the frame of the step before; zeros without."""
        count, rate, shrink = self.count, self.rate[:, None], self.shrink[:, None]
        met = self.labels.select("d", "n", F.col("feature").alias("y"), F.col("row").alias("val"), F.col("value").alias("w"))
        if before is not None:
            met = met.join(before.select("d", "u", "r"), "d").join(sums, "d", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for x in batch.to_pylist():
                    y, val, w = _unpacked(x["y"], np.int8), _unpacked(x["val"], np.int8) > 0, _unpacked(x["w"], float)
                    z, u, r = (np.zeros((count, x["n"])) if x.get(c) is None else np.frombuffer(x[c]).reshape(count, -1) for c in ("z", "u", "r"))
                    w = np.where(val, 0.0, w)
                    z, u = z + constant[:, None], u - rate * (r + shrink * u)
                    small = np.exp(-np.abs(z))
                    r = w * (np.where(z >= 0, 1.0, small) / (1.0 + small) - y)
                    loss = (w * (np.log1p(small) + np.maximum(z, 0.0) - z * y)).sum(axis=1)
                    right = ((z > 0) == (y > 0))[:, val].sum(axis=1)
                    out.append({"d": x["d"], "u": u.tobytes(), "r": (r / total if total else r).tobytes(), "total": float(w.sum()), "residual": r.sum(axis=1).tolist(), "loss": loss.tolist(), "val_rows": int(val.sum()), "val_right": right.tolist()})
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_pylist(out, pa.schema([(c.split()[0], k) for c, k in zip(ROWS_SCHEMA.split(", "), kinds, strict=True)]))

        return met.mapInArrow(run, ROWS_SCHEMA).checkpoint(eager=True)  # else a step's plan would hold those of all steps before

    def added(self, rows: DataFrame) -> tuple[float, np.ndarray, np.ndarray, int, np.ndarray]:
        """Weight, residuals and loss of the training rows, validation rows and how many of them each candidate gets right."""
        per = [F.sum(F.get(c, k)).alias(f"{c}{k}") for c in ("residual", "loss", "val_right") for k in range(self.count)]
        x = rows.agg(F.sum("total").alias("total"), F.sum("val_rows").alias("val_rows"), *per).first()
        return x["total"] or 0.0, *(np.array([x[f"{c}{k}"] or 0.0 for k in range(self.count)]) for c in ("residual", "loss")), x["val_rows"] or 0, np.array([x[f"val_right{k}"] or 0 for k in range(self.count)])

    def _met(self, rows: DataFrame) -> DataFrame:
        return self.cells.where("f >= 0").join(F.broadcast(rows.select("d", "u", "r")), "d")

    def step(self, rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """A scan of the blocks: the groups' (d, z) under the weights after a step, and the squared length of the features' gradient."""
        count, rate, shrink = self.count, self.rate, self.shrink
        schema = pa.schema([("d", pa.int64()), ("z", pa.binary())])

        def batch(held: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"d": d, "z": z.tobytes()} for d, z in held.items()], schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, squares = {}, 0, np.zeros(count)
            for _, cells in _by_block(batches, count):
                w, slope = _block_weights(cells, rate, shrink)
                squares += (slope * slope).sum(axis=1)
                for cell in cells:
                    feature, row, value = _entries(cell)
                    if cell[0] not in held:
                        held[cell[0]] = np.zeros((count, cell[1]))
                        size += held[cell[0]].nbytes
                    for c in range(count):
                        held[cell[0]][c] += np.bincount(row, weights=value * w[c][feature], minlength=cell[1])
                if size > HELD_BYTES:
                    yield batch(held)
                    held, size = {}, 0
            yield batch(held | {-1: squares})

        def add(met: pa.Table) -> pa.Table:
            z = np.sum([np.frombuffer(x) for x in met.column("z").to_pylist()], axis=0)
            return pa.Table.from_pylist([{"d": met.column("d")[0].as_py(), "z": z.tobytes()}], schema)

        sums = self._met(rows).mapInArrow(run, "d long, z binary").groupBy("d").applyInArrow(add, "d long, z binary").persist(StorageLevel.MEMORY_AND_DISK)
        squares = sums.where("d = -1").first()
        return sums, np.zeros(count) if squares is None else np.frombuffer(squares["z"])

    def weights(self, rows: DataFrame) -> DataFrame:
        """(candidate, index, weight): the features' weights after the step from ``rows``."""
        count, rate, shrink, blocks = self.count, self.rate, self.shrink, self.blocks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for f, cells in _by_block(batches, count):
                w, _ = _block_weights(cells, rate, shrink)
                some = np.unique(np.concatenate([_entries(x)[0] for x in cells]))
                for c in range(count):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), c, np.int32)), pa.array(some.astype(np.int64) * blocks + f), pa.array(w[c][some])], names=["candidate", "index", "weight"])

        return self._met(rows).mapInArrow(run, "candidate int, index long, weight double")
