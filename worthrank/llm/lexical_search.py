"""Ranked lexical search: the best documents for each item of a query table by term impacts, exactly.

A document is the sparse vector of its impacts, an item the vector of its terms' weights, and a score their inner product.
The items come in blocks of a bounded number of terms. For a block the documents are read once and keep the impacts of the
block's terms alone; statistics are sums over all documents. Each task then puts its vectors into ball trees of a bounded
size, one after the other, and searches every tree best first for every item, with the k best of the trees before as the
bound to beat. The k best of the tasks are merged in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worthrank.llm.ball_tree import SLACK, BallTree, Sparse, search
from worthrank.llm.common import map_arrow, materialise, text_batches
from worthrank.session import ship_package

#: Bytes of UTF-8 that belong to terms: digits, letters and all that isn't ASCII; A-Z become a-z, all others a space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term): the distinct terms of each item; rows with the same id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            own = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
            ids = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array([t for x in own for t in x], pa.binary())], names=["item_id", "term"])

    return map_arrow(items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "item_id long, term binary").distinct()


def project(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, index, tf): each document's number of terms and, of the vocabulary's, which it has how often (int32)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in text_batches(batches):
            n, index, tf = [], [], []
            for text in batch.column(1).to_pylist():
                own = terms(text)
                at = np.array([number[t] for t in own if t in number], np.int32)
                places, times = np.unique(at, return_counts=True)
                n.append(len(own))
                index.append(places.tobytes())
                tf.append(times.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(index, pa.binary()), pa.array(tf, pa.binary())],
                                             names=["doc_id", "n", "index", "tf"])

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "doc_id long, n long, index binary, tf binary")


def document_frequencies(vectors: DataFrame, width: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=width)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["term", "df"])

    out = np.zeros(width, np.int64)
    for r in map_arrow(vectors.select("index"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(n: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L, for each tf and the length n of its document."""
    if len(n) and 50 * int(n.max()) * n_docs >= 1 << 63:
        m = np.array([50 + 50 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    else:
        m = 50 + 50 * n * n_docs // max(1, n_terms)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Best:
    """The k best (score, document) of an item so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1.0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        own = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[own], ids[own]
        if len(own) == self.k:
            self.least = float(self.scores[-1])


class Items:
    """A block's items as sparse rows of weights, and the bounds of a ball for all of them at once."""

    def __init__(self, starts: np.ndarray, index: np.ndarray, weights: np.ndarray, width: int, block: int):
        self.rows = Sparse(starts, index, weights, width)
        #: Coordinates are impacts times the square root of the weight, on both sides, so that rare terms stretch the space.
        self.side = np.sqrt(weights.astype(float))
        at = index // block
        new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
        new[starts[:-1][np.diff(starts) > 0]] = True
        self.first = np.flatnonzero(new)  # of each part of an item in a block of coordinates
        self.blocks = at[self.first]
        self.norms = np.sqrt(np.add.reduceat(weights.astype(float), self.first)) if len(self.first) else np.zeros(0)
        self.parts = Sparse(np.searchsorted(self.first, starts), self.blocks, self.norms, 0)

    def bounds(self, mean: np.ndarray, radii: np.ndarray) -> np.ndarray:
        at_mean = self.rows.row_sums(self.side * mean[self.rows.index])
        return (at_mean + self.parts.row_sums(self.norms * radii[self.blocks])) * (1 + SLACK) + 1e-3


def search_block(vectors: Iterator[tuple[np.ndarray, Sparse]], items: Items, term_weights: np.ndarray, k: int, leaf: int, block: int) -> tuple[list[Best], dict[str, int]]:
    """The k best of each item over trees of (doc ids, impacts), and how much was scored. Only scores above 0 count."""
    best = [Best(k) for _ in range(len(items.rows))]
    done = {"trees": 0, "documents": 0, "scored": 0}
    stretch = np.sqrt(term_weights.astype(float))
    dense = np.zeros(len(term_weights), np.int64)
    for ids, rows in vectors:
        tree = BallTree(Sparse(rows.starts, rows.index, rows.value * stretch[rows.index], rows.width), leaf, block, items.bounds)
        rows, ids = rows.take(tree.order), ids[tree.order]
        bounds = np.stack(tree.kept, axis=1) if len(tree.kept) else np.zeros((len(best), 0))
        done["trees"] += 1
        done["documents"] += len(ids)
        for i, own in enumerate(best):
            there = items.rows.index[items.rows.starts[i] : items.rows.starts[i + 1]]
            dense[there] = term_weights[there]

            def score(first: int, last: int, own: Best = own) -> None:
                starts = rows.starts[first : last + 1]
                part = Sparse(starts - starts[0], rows.index[starts[0] : starts[-1]], rows.value[starts[0] : starts[-1]], rows.width)
                own.add(part.sums(part.value * dense[part.index]), ids[first:last])
                done["scored"] += last - first

            search(tree, bounds[i], lambda own=own: own.least, score)
            dense[there] = 0
    return best, done


FOUND = "item int, part int, doc_id long, score long"


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", block_terms: int = 50_000, tree_rows: int = 8192, tree_entries: int = 2_000_000, leaf: int = 16, block: int = 1) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item, equal scores by id.

    Rows with the same item id are one item; a null item id is one too. Items without terms, and those that share no term with
    any document, have no rows. Documents without id count in the statistics but are not ranked; repeated rows are documents
    of their own. Null and empty texts have no terms. Empty tables give no rows; other columns are ignored.

    Items are dealt to blocks by a hash of their id, so many that a block has ``block_terms`` (item, term) pairs on average;
    a block's pairs are what reaches the tasks. A tree has ``tree_rows`` documents and ``tree_entries`` impacts at most (or one
    document), a leaf ``leaf`` (more only of equal vectors). Radii are kept per ``block`` neighbouring coordinates."""
    spark = docs.sparkSession
    ship_package(spark)
    pairs = materialise(item_terms(items, item_col, item_text_col), "item_terms")
    blocks = max(1, -(-pairs.count() // block_terms))
    out = None
    for b in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        found = _rank_block(docs, own, k, id_col, text_col, tree_rows, tree_entries, leaf, block)
        out = found if out is None else out.unionByName(found)
    return out


def _rank_block(docs: DataFrame, pairs: list, k: int, id_col: str, text_col: str, tree_rows: int, tree_entries: int, leaf: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in pairs}))}
    item_ids = sorted({r.item_id for r in pairs}, key=lambda i: (i is not None, i))
    place = {i: n for n, i in enumerate(item_ids)}
    held = np.array(sorted((place[r.item_id], vocabulary[bytes(r.term)]) for r in pairs), np.int64).reshape(-1, 2)
    vectors = materialise(project(docs, vocabulary, id_col, text_col), "impact_terms")
    n_docs, n_terms = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(vectors, len(vocabulary))
    weights = np.array([weight(n_docs, x) for x in df.tolist()], np.int64)
    starts = np.searchsorted(held[:, 0], np.arange(len(item_ids) + 1))
    shared = spark.sparkContext.broadcast((starts, held[:, 1], weights))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Sparse]]:
        ids: list[int] = []
        lengths: list[int] = []
        index: list[bytes] = []
        tf: list[bytes] = []
        entries = 0

        def tree() -> tuple[np.ndarray, Sparse]:
            n = np.array([len(x) // 4 for x in index], np.int64)
            times = np.frombuffer(b"".join(tf), np.int32).astype(np.int64)
            value = impacts(np.repeat(np.array(lengths, np.int64), n), times, n_docs, n_terms)
            return np.array(ids, np.int64), Sparse(np.concatenate([[0], np.cumsum(n)]), np.frombuffer(b"".join(index), np.int32).astype(np.int64), value, len(weights))

        for batch in batches:
            for doc, n, places, times in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if ids and (len(ids) >= tree_rows or entries + len(places) // 4 > tree_entries):
                    yield tree()
                    ids, lengths, index, tf, entries = [], [], [], [], 0
                ids.append(doc)
                lengths.append(n)
                index.append(places)
                tf.append(times)
                entries += len(places) // 4
        if ids:
            yield tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, index, weights = shared.value
        best, _ = search_block(trees(batches), Items(starts, index, weights[index], len(weights), block), weights, k, leaf, block)
        n = [len(b.ids) for b in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best)), n), pa.int32()), pa.array(np.full(sum(n), TaskContext.get().partitionId() % 1024), pa.int32()),
             pa.array(np.concatenate([np.zeros(0, np.int64), *(b.ids for b in best)])), pa.array(np.concatenate([np.zeros(0, np.int64), *(b.scores for b in best)]))],
            names=["item", "part", "doc_id", "score"])

    # A document without any of the terms has score 0.
    found = map_arrow(vectors.where("doc_id is not null and length(index) > 0").select("doc_id", "n", "index", "tf"), run, FOUND)
    order = (F.desc("score"), F.asc("doc_id"))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, i in enumerate(item_ids)], "item int, item_id long")
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")
