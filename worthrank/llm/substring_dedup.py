"""Removal of repeated passages by fixed-block anchors.

Every document's non-overlapping blocks of seven words, at word 0, 7, 14 and so on, are the reference
index; all rolling windows of seven words of all documents probe it. Any passage of thirteen words that two
documents share covers a whole block of either, so it is hit in both. Hits are extended to the
windows of thirteen words around them, and those are compared exactly across documents: a window whose
words also start in a document with a smaller id covers words that go.

Hashes are shuffled packed: for a slice of the input and a range of hash values one row holds all keys. A range
holds a bounded number of keys, so the lower 32 bits tell its anchors apart but for some in ten thousand, which
cost a needless comparison of windows and nothing else; windows keep 64 bits.
The index rows of a range come first, two entries per distinct key at most, and the probes stream past them, so a
passage that a third of all documents share costs time in proportion to its probes, but no memory. Hits go back
packed too: one row holds those of a task for a bucket of documents, and meets the texts of the bucket in one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from worthrank.llm.common import map_arrow, materialise, release_shuffles
from worthrank.llm.shingles import Words, byte_slices, runs_of

BLOCK = 7
LOW32 = np.uint64(2**32 - 1)
PACKED_SCHEMA = "bucket int, kind int, keys binary, a binary, b binary"
HITS_SCHEMA = "bucket int, docs binary, counts binary, keys binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
_HITS = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
#: Documents are dealt into buckets by a linear congruence, which numpy and Spark compute alike.
_PRIME, _FACTOR = 2**31 - 1, 1_103_515_245


def _buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _document_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return docs % _PRIME * _FACTOR % _PRIME % buckets


def entries(keys: np.ndarray, docs: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the entries of the index, numbers of those that no entry stands for). Each distinct key has an entry
    with the smallest document that has it and, if ``both``, one with the largest where that is another. An entry
    stands for all equal pairs of key and document."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    at = runs_of(keys)
    size = np.diff(np.append(at, len(keys)))
    end = at + size - 1
    apart = docs != np.repeat(docs[at], size)
    if both:
        apart &= docs != np.repeat(docs[end], size)
        at = np.sort(np.concatenate([at, end[docs[end] != docs[at]]]))
    return order[at], np.sort(order[apart])


def index_rows(keys: np.ndarray, docs: np.ndarray, bits: int, short: bool) -> list[tuple]:
    """Packed rows of kind 0: keys, in order, and their documents."""
    buckets = _buckets(keys, bits)
    cuts = np.append(runs_of(buckets), len(keys))
    return [(int(buckets[i]), 0, _pack(keys[i:j], short), docs[i:j].tobytes(), None) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def probe_rows(keys: np.ndarray, docs: np.ndarray, bits: int, short: bool) -> list[tuple]:
    """Packed rows of kind 1: all keys, documents as runs (steps from id to id, and counts)."""
    buckets = _buckets(keys, bits)
    order = np.argsort(buckets, kind="stable")  # documents stay together within a bucket
    keys, docs, buckets = keys[order], docs[order], buckets[order]
    cuts = np.append(runs_of(buckets), len(keys))
    rows = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        at = runs_of(docs[i:j])
        rows.append((int(buckets[i]), 1, _pack(keys[i:j], short), np.diff(docs[i:j][at], prepend=0).tobytes(), np.diff(np.append(at, j - i)).astype("<u4").tobytes()))
    return rows


def _pack(keys: np.ndarray, short: bool) -> bytes:
    return (keys & LOW32).astype("<u4").tobytes() if short else keys.astype("<u8").tobytes()


def _unpack(data: bytes, short: bool) -> np.ndarray:
    return np.frombuffer(data, "<u4" if short else "<u8").astype(np.uint64)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def match(packed: DataFrame, partitions: int, buckets: int, earlier_only: bool, short: bool, most_held: int = 1_000_000) -> DataFrame:
    """The probes that the index has from another document, or, if ``earlier_only``, from one with a smaller id. The
    entries of the index are probes of their own. A row holds hits of one of ``buckets`` buckets of
    documents: documents, how many keys each has, and the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, index = None, [], None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def build(parts: list) -> tuple:
            """Distinct keys, their smallest and largest documents, and the entries that they come from."""
            keys, docs = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            order = np.argsort(keys, kind="stable")
            keys, docs = keys[order], docs[order]
            at = runs_of(keys)
            return keys[at], np.minimum.reduceat(docs, at), np.maximum.reduceat(docs, at), (keys, docs)

        def find(probe: np.ndarray, docs: np.ndarray) -> None:
            at = np.minimum(np.searchsorted(index[0], probe), len(index[0]) - 1)
            other = index[1][at] < docs if earlier_only else (index[1][at] != docs) | (index[2][at] != docs)
            hit = np.flatnonzero((index[0][at] == probe) & other)
            if len(hit):
                held.append((docs[hit], probe[hit]))

        def flush() -> pa.RecordBatch:
            docs, keys = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            of = _document_bucket(docs, buckets)
            order = np.lexsort((keys, docs, of))
            of, docs, keys = of[order], docs[order], keys[order]
            new = np.append(True, (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1]))
            of, docs, keys = of[new], docs[new], keys[new]
            cuts = np.append(runs_of(of), len(of))
            rows = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                at = runs_of(docs[i:j])
                rows.append((int(of[i]), docs[i:j][at].astype("<i8").tobytes(), np.diff(np.append(at, j - i)).astype("<u4").tobytes(), _pack(keys[i:j], short)))
            return _batch(rows, _HITS)

        for batch in batches:
            for own, kind, keys, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != bucket:
                    if index is None and parts:
                        index = build(parts)
                        find(*index[3])
                    bucket, parts, index = own, [], None
                if kind == 0:
                    parts.append((_unpack(keys, short), np.frombuffer(a, "<i8")))
                    continue
                if index is None:
                    if not parts:
                        continue  # nothing to find in this range
                    index, parts = build(parts), []
                    find(*index[3])
                find(_unpack(keys, short), np.repeat(np.cumsum(np.frombuffer(a, "<i8")), np.frombuffer(b, "<u4")))
                if sum(len(h[0]) for h in held) >= most_held:
                    yield flush()
                    held.clear()
        if index is None and parts:
            index = build(parts)
            find(*index[3])
        if held:
            yield flush()

    dealt = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket", "kind")
    return map_arrow(dealt, run, HITS_SCHEMA)


def deal(texts: DataFrame, hits: DataFrame, bucket: Column, partitions: int) -> DataFrame:
    """``texts`` dealt by ``bucket``, with the hits of a bucket before its texts. The last five columns are the
    bucket, the kind (0: hits, 1: a text) and those of the hits."""
    own = texts.select("*", bucket.cast("int").alias("__bucket"), F.lit(1).alias("__kind"))
    packed = hits.select(F.col("bucket").alias("__bucket"), F.lit(0).alias("__kind"), F.col("docs").alias("__docs"), F.col("counts").alias("__counts"), F.col("keys").alias("__keys"))
    return own.unionByName(packed, allowMissingColumns=True).repartition(partitions, "__bucket").sortWithinPartitions("__bucket", "__kind")


def routed(batches: Iterator[pa.RecordBatch], text: int, short: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the texts of a bucket with (documents in order, keys) of its hits, from rows as ``deal`` leaves them;
    ``text`` is the number of the text column."""
    at, held, docs, keys = None, [], np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        bucket, kind = (np.array(batch.column(batch.num_columns - k).to_numpy(zero_copy_only=False), np.int64) for k in (5, 4))
        cuts = np.append(runs_of(2 * bucket + kind), batch.num_rows)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if bucket[i] != at:
                at, held = bucket[i], []
                docs, keys = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            if kind[i] == 0:
                held += zip(*(batch.column(batch.num_columns - k).slice(i, j - i).to_pylist() for k in (3, 2, 1)), strict=True)
                continue
            if held:
                docs = np.concatenate([np.repeat(np.frombuffer(d, "<i8"), np.frombuffer(c, "<u4")) for d, c, _ in held])
                keys = np.concatenate([_unpack(k, short) for _, _, k in held])
                order = np.argsort(docs, kind="stable")
                docs, keys, held = docs[order], keys[order], []
            for part in byte_slices(iter([batch.slice(i, j - i)]), text):
                yield part, docs, keys


def _marked(words: Words, runs: np.ndarray, ids: pa.Array, docs: np.ndarray, keys: np.ndarray, low: bool) -> np.ndarray:
    """Which words begin a run whose key is among the hits of the row's document. A null id has none."""
    found = np.zeros(len(runs), bool)
    known = np.flatnonzero(np.array(ids.is_valid()))
    own = np.array(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    first, last = (np.searchsorted(docs, own, side=x) for x in ("left", "right"))
    for row in known[first[known] < last[known]].tolist():
        i, j = words.first[row], words.first[row + 1]
        found[i:j] = np.isin(runs[i:j] & LOW32 if low else runs[i:j], keys[first[row] : last[row]])
    return found


def dedup_passages(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = 4_000_000,
                   bucket_bytes: int = 8_000_000) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (replacing columns of those names).

    Words are cut at ASCII white space. A word goes if it is in a window of ``window`` consecutive words of its
    document whose words also start in a document with a smaller id; all windows are judged on the input. kept_text
    joins the words that stay by one space. Null texts have no words; shorter texts than a window and rows
    with a null id lose nothing; rows that share an id count as one document. Windows are compared by
    64-bit hashes. Hash ranges are of about ``bucket_keys`` keys, buckets of documents of about ``bucket_bytes`` bytes of
    text. ``window`` must be at least 13, so that every window covers a block of seven words."""
    if window < 2 * BLOCK - 1:
        raise ValueError(f"a window of fewer than {2 * BLOCK - 1} words may cover no whole block")
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_removed", "kept_text")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).where("doc_id is not null and text is not null")
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1.0, chars / 6 / bucket_keys)))))
    cores = 2 * spark.sparkContext.defaultParallelism
    partitions = min(2**bits, max(2**bits // 4, cores))
    buckets = max(1, -(-chars // bucket_bytes))
    text_partitions = min(buckets, max(buckets // 4, cores))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 1):
            words = Words(part.column(1))
            ids = np.array(part.column(0).to_numpy(zero_copy_only=False), np.int64)
            starts = words.run_starts(BLOCK)
            keys = words.runs(BLOCK)[starts]
            rows = words.row_of_word()[starts]
            aligned = np.flatnonzero((starts - words.first[rows]) % BLOCK == 0)
            of = ids[rows]
            own, rest = entries(keys[aligned], of[aligned], True)
            probes = np.ones(len(keys), bool)
            probes[aligned] = False
            probes[aligned[rest]] = True
            yield _batch(index_rows(keys[aligned[own]], of[aligned[own]], bits, True) + probe_rows(keys[probes], of[probes], bits, True), _PACKED)

    hits = materialise(match(map_arrow(texts, anchors, PACKED_SCHEMA), partitions, buckets, earlier_only=False, short=True), "anchor-hits")
    release_shuffles(spark)

    def bucket_of(doc_id: Column) -> Column:
        return F.pmod(F.pmod(doc_id, F.lit(_PRIME)) * F.lit(_FACTOR), F.lit(_PRIME)) % F.lit(buckets)

    near = deal(texts, hits, bucket_of(F.col("doc_id")), text_partitions)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hit_docs, hit_keys in routed(batches, 1, True):
            words = Words(part.column(1))
            ids = np.array(part.column(0).to_numpy(zero_copy_only=False), np.int64)
            hit = _marked(words, words.runs(BLOCK), part.column(0), hit_docs, hit_keys, True)
            upto = np.concatenate([[0], np.cumsum(hit)])
            starts = words.run_starts(window)
            starts = starts[upto[starts + window - BLOCK + 1] > upto[starts]]  # those that cover a hit
            keys, of = words.runs(window)[starts], ids[words.row_of_word()[starts]]
            # of documents of the slice that share a window, the smallest stands in the index; the others probe it
            own, rest = entries(keys, of, False)
            yield _batch(index_rows(keys[own], of[own], bits, False) + probe_rows(keys[rest], of[rest], bits, False), _PACKED)

    repeats = materialise(match(map_arrow(near, windows, PACKED_SCHEMA), partitions, buckets, earlier_only=True, short=False), "repeated-windows")
    release_shuffles(spark)
    width = len(docs.columns)
    plain = isinstance(docs.schema[text_col].dataType, StringType)  # then the text travels once, as bytes
    own_bytes = F.col(text_col).cast("string").cast("binary")
    sent = docs.withColumn(text_col, own_bytes) if plain else docs
    text_at = docs.columns.index(text_col) if plain else width + 1
    whole = sent.select("*", F.col(id_col).cast("long").alias("__id"), *([] if plain else [own_bytes.alias("__bytes")]))
    loose = F.pmod(F.xxhash64(text_col), F.lit(buckets))  # rows without an id go anywhere
    joined = deal(whole, repeats, F.coalesce(bucket_of(F.col("__id")), loose), text_partitions)
    schema = sent.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_text")).schema

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hit_docs, hit_keys in routed(batches, text_at, False):
            words = Words(part.column(text_at))
            starts = np.flatnonzero(_marked(words, words.runs(window), part.column(width), hit_docs, hit_keys, False))
            starts = np.intersect1d(starts, words.run_starts(window))
            edge = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            covered = np.cumsum(edge)[:-1] > 0
            removed, kept = [], []
            for row, text in enumerate(part.column(text_at).to_pylist()):
                i, j = words.first[row], words.first[row + 1]
                own = (text or b"").split()
                out = covered[i:j]
                removed.append(int(out.sum()))
                kept.append(b" ".join([w for w, x in zip(own, out.tolist(), strict=True) if not x] if removed[-1] else own).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=[f.name for f in schema.fields])

    done = map_arrow(joined, remove, schema)
    return done.withColumn(text_col, F.col(text_col).cast("string")) if plain else done
