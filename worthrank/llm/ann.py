"""Approximate nearest neighbours by inner product over randomly rotated one-bit codes.

Vectors are centred and rotated by a fixed random orthogonal matrix; of each rotated residual only the
signs are indexed, packed, with two correction scalars: its norm and the inner product of the unit
residual with its own code. From these the inner product with a query is estimated without
bias, with an error that the second scalar bounds. Only vectors whose upper bound reaches the k-th best
lower bound are ranked by the exact product of the original vectors.

Queries and vectors meet in a grid of blocks of bounded size, one cell a task call; a cell returns k
rows a query, and the cells' rows are merged by a top-k window, which Spark limits before its shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worthrank.llm.common import materialise
from worthrank.session import ship_package


def rotation(dims: int, seed: int = 17) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine for a seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def usable(vector) -> F.Column:
    """Not null, not empty, all components finite and not null, not all zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(sound, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, norms of residuals, inner products of unit residuals with their codes)."""
    residual = (vectors - centre) @ turn
    norm = np.linalg.norm(residual, axis=1)
    signs = residual > 0
    dims = vectors.shape[1]
    own = np.abs(residual).sum(axis=1) / (np.sqrt(dims) * np.where(norm > 0, norm, 1.0))
    return np.packbits(signs, axis=1), norm, np.where(norm > 0, own, 1.0)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, seed: int = 17) -> tuple[DataFrame, np.ndarray]:
    """(index of every distinct usable vector, centre), the index written to shared storage.

    Columns: vec_id, vector (double), code, norm, own. Of equal vectors only the k + 1 rows with the smallest
    ids are indexed: no query can return more of them, itself apart, as ties go to smaller ids. So a group of
    copies of any size costs no more than k + 1 rows, and the ranking is unchanged. The centre is the
    mean of the indexed vectors. Vectors of another length than the most frequent one of those (of equally frequent
    ones the longest) are left out."""
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("same", F.xxhash64("vector"))
    copies = Window.partitionBy("same", "vector").orderBy("vec_id")
    held = materialise(rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("vec_id", "vector"), "vectors")
    sizes = held.groupBy(F.size("vector").alias("dims")).count().collect()
    if not sizes:
        return held.select("*", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("norm"), F.lit(1.0).alias("own")), np.zeros(0)
    dims = max(sizes, key=lambda r: (r["count"], r["dims"]))["dims"]
    if len(sizes) > 1:
        held = held.where(F.size("vector") == dims)
    means = held.select([F.avg(F.col("vector")[i]).alias(str(i)) for i in range(dims)]).first()
    centre = np.array([means[str(i)] for i in range(dims)])

    def run(batches):
        turn = rotation(dims, seed)
        for batch in batches:
            code, norm, own = encode(np.stack(batch["vector"].to_numpy()), centre, turn) if len(batch) else ([], [], [])
            yield batch.assign(code=[c.tobytes() for c in code], norm=norm, own=own)

    schema = "vec_id long, vector array<double>, code binary, norm double, own double"
    return materialise(held.mapInPandas(run, schema), "codes"), centre


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: np.ndarray, norm: np.ndarray,
                  own: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, exact products) of the best ``k`` vectors of a block, found through their codes."""
    dims, first = vectors.shape[1], min(k, len(ids))
    signs = np.unpackbits(codes, axis=1, count=dims).astype(np.float32) * 2 - 1
    # <q, x> = <q, centre> + norm * <q, unit residual>; the last is estimated by <q, code> / <unit residual, code>
    scale = norm / own / np.sqrt(dims)
    estimate = (queries @ turn).astype(np.float32) @ (signs * scale[:, None].astype(np.float32)).T
    centred = queries @ centre
    by_id = np.argsort(ids)
    itself = by_id[np.minimum(np.searchsorted(ids, query_ids, sorter=by_id), len(ids) - 1)]
    met = np.flatnonzero(ids[itself] == query_ids)
    estimate[met, itself[met]] = -np.inf  # a query isn't its own neighbour
    # the exact products of some vectors with high estimates, the best of each of many parts of the block, give a score
    # that the k-th best vector has at least
    parts = min(len(ids), max(4 * first, 64))
    cuts = np.linspace(0, len(ids), parts + 1).astype(int)[:-1]
    peaks = np.maximum.reduceat(estimate, cuts, axis=1)
    likely = np.argpartition(peaks, parts - first, axis=1)[:, parts - first :]
    level = np.take_along_axis(peaks, likely, axis=1).min(axis=1)
    # an estimate errs by norm * |q| * sqrt(1 / own² - 1) * slack / sqrt(dims - 1) at most, but for rare cases
    spread = norm * np.sqrt(np.maximum(1 / own**2 - 1, 0)) * slack / np.sqrt(max(dims - 1, 1)) + 1e-6 * (norm + 1)
    spread = spread.astype(np.float32)
    length = np.linalg.norm(queries, axis=1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, query in enumerate(queries):
        own_estimate = estimate[i]
        near = np.flatnonzero(own_estimate >= level[i]) if np.isfinite(level[i]) else np.zeros(0, np.int64)
        if len(near) >= first:
            floor = np.partition(_products(vectors[near], query), len(near) - first)[len(near) - first]
            near = np.flatnonzero(own_estimate + spread * np.float32(length[i]) >= np.float32(floor - centred[i] - 1e-5 * (length[i] + abs(floor))))
        else:
            near = np.flatnonzero(np.isfinite(own_estimate))
        exact = _products(vectors[near], query)
        if len(near) > k:  # with all ties of the k-th
            top = np.flatnonzero(exact >= np.partition(exact, len(near) - k)[len(near) - k])
            near, exact = near[top], exact[top]
        order = np.lexsort((ids[near], -exact))[:k]
        found.append((np.full(len(order), query_ids[i]), ids[near[order]], exact[order]))
    return tuple(np.concatenate([f[c] for f in found]) for c in range(3))


def _products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products, all summed in the same order, so that equal vectors have equal ones."""
    return np.einsum("ij,j->i", vectors, query)


def search(index: DataFrame, centre: np.ndarray, queries: DataFrame, k: int = 20, slack: float = 1.9, block_rows: int = 8192,
           block_queries: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 17) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every usable query row: its ``k`` nearest, nearest first, ties
    to the smaller id, without itself; all candidates if there are fewer.

    ``slack`` scales the error bound; larger values rank more vectors exactly. A query that is null, zero or has
    components that are null or not finite has no rows, as one of another length than the index has. Rows that repeat a query's id give the same rows once."""
    ship_package(queries.sparkSession)
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = asked.where(F.col("query_id").isNotNull() & usable(F.col("vector")) & (F.size("vector") == len(centre))).dropDuplicates(["query_id"])
    n_rows, n_queries = index.count(), asked.count()
    schema = "query_id long, vec_id long, score double"
    if not n_rows or not n_queries:
        found = index.select(F.col("vec_id").alias("query_id"), "vec_id", F.col("norm").alias("score")).limit(0)
    else:
        rows, cols = -(-n_queries // block_queries), -(-n_rows // block_rows)
        left = (asked.withColumn("row", F.pmod(F.xxhash64("query_id"), F.lit(rows)))
                .withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)).cast("array<long>"))))
        right = (index.withColumn("col", F.pmod(F.xxhash64("vec_id"), F.lit(cols)))
                 .withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)).cast("array<long>"))))

        def cell(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(x):
                return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
            codes = np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x), -1)
            vectors, asked_vectors = np.stack(x["vector"].to_numpy()), np.stack(q["vector"].to_numpy())
            turn = rotation(len(centre), seed)
            found = [best_of_block(asked_vectors[at : at + 256], q["query_id"].to_numpy()[at : at + 256], vectors, x["vec_id"].to_numpy(),
                                   codes, x["norm"].to_numpy(), x["own"].to_numpy(), centre, turn, k, slack) for at in range(0, len(q), 256)]
            return pd.DataFrame({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(("query_id", "vec_id", "score"))})

        found = left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInPandas(cell, schema)
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
