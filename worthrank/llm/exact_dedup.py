"""Exact de-duplication by a tree merge of sorted digest runs.

Documents are digested where they are read: SHA-256 of the text with every run of white space as one space. A task
sorts its digests into runs and keeps of equal ones a single entry with the smallest document and the number of rows.
The runs then meet in binomial rounds: in round r the partitions whose numbers differ in the r-th digit alone exchange
parts of their runs, cut by the r-th digit of the digest, and each merges the sorted parts that it gets. After the last
round a partition holds one range of digests, merged from all others. No partition ever holds more than its share, and
a digest that a third of all rows have is one entry per run from the first round on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthrank.llm.common import map_arrow, materialise, text_batches
from worthrank.session import ship_package

#: An entry of a run: the digest as four big-endian words, the length of the digested bytes, then the document that
#: stays (one without id only if there is no other; equal ids by row number) and the number of rows.
ENTRY = np.dtype([("d0", "<u8"), ("d1", "<u8"), ("d2", "<u8"), ("d3", "<u8"), ("bytes", "<i8"),
                  ("no_id", "u1"), ("id", "<i8"), ("row", "<i8"), ("n", "<i8")])
WORDS = ("d0", "d1", "d2", "d3")
#: Bits of a row number within its run; the run's number stands above them.
ROW_BITS = 20


def normalise(text: str | None) -> bytes:
    """The UTF-8 text with each run of space and the controls from tab to carriage return as one space, at the ends too."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return b" " if raw else b""
    return (b" " if raw[:1].isspace() else b"") + b" ".join(words) + (b" " if raw[-1:].isspace() else b"")


def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of several, equal entries as one with the smallest document and all rows. Entries are equal only if
    the whole digest and the length agree."""
    held = np.concatenate(runs) if runs else np.zeros(0, ENTRY)
    held = held[np.argsort(held["d0"], kind="stable")]  # merges the runs, which are sorted by it
    if len(held) and (held["d0"][1:] == held["d0"][:-1]).any():
        held = held[np.lexsort([held[c] for c in ("row", "id", "no_id", "bytes", "d3", "d2", "d1", "d0")])]
    if not len(held):
        return held
    other = np.zeros(len(held) - 1, bool)
    for c in (*WORDS, "bytes"):
        other |= held[c][1:] != held[c][:-1]
    first = np.flatnonzero(np.r_[True, other])
    out = held[first]
    out["n"] = np.add.reduceat(held["n"], first)
    return out


def digests(docs: DataFrame, run_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, bytes, run, row): the SHA-256 of every normalised text, its length, the number of the run that the row
    belongs to and the row's own number. Written to shared storage, so that both numbers hold in later retries."""
    schema = "doc_id long, digest binary, bytes long, run long, row long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        at = 0
        for batch in text_batches(batches):
            texts = [normalise(x) for x in batch.column(1).to_pylist()]
            rows = np.arange(at, at + len(texts))
            at += len(texts)
            runs = (task << 16) + rows // run_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()), pa.array([len(x) for x in texts], pa.int64()),
                 pa.array(runs), pa.array((runs << ROW_BITS) + rows % run_rows)], names=["doc_id", "digest", "bytes", "run", "row"])

    return materialise(map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, schema), "digests")


def first_runs(rows: DataFrame, partitions: int) -> DataFrame:
    """(at, run, entries): the sorted runs of ``digests`` with the partition where each begins. A run that is read in parts
    gives as many rows."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        own, entries = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        return run_rows_of([(k % partitions, k, merge_runs([entries[own == k]])) for k in np.unique(own).tolist()])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            ids, digest, size, run, row = (batch.column(i) for i in range(5))
            entries = np.zeros(batch.num_rows, ENTRY)
            words = np.frombuffer(b"".join(digest.to_pylist()), ">u8").reshape(-1, 4)
            for i, c in enumerate(WORDS):
                entries[c] = words[:, i]
            entries["bytes"], entries["row"], entries["n"] = size.to_numpy(), row.to_numpy(), 1
            entries["no_id"], entries["id"] = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            held.append((run.to_numpy(), entries))
            if sum(len(x) for x, _ in held) >= 200_000:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    return map_arrow(rows.select("doc_id", "digest", "bytes", "run", "row"), sort, RUN_SCHEMA)


RUN_SCHEMA = "at int, run long, entries binary"


def run_rows_of(runs: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    columns = list(zip(*((at, run, entries.tobytes()) for at, run, entries in runs if len(entries)), strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)],
                                      names=["at", "run", "entries"])


def exchange(runs: DataFrame, low: int, bits: int, total: int) -> DataFrame:
    """One round: a run at partition p is cut by ``bits`` bits of the digest, those from bit ``low`` on of its top ``total``
    bits, and the part with value v goes to the partition that has v in place of these bits of p. What meets there is merged."""
    mask = (1 << bits) - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, run, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                entries = np.frombuffer(blob, ENTRY)
                value = (entries["d0"] >> np.uint64(64 - total + low)).astype(np.int64) & mask
                yield run_rows_of([(at & ~(mask << low) | int(v) << low, run, entries[value == v]) for v in np.unique(value)])

    def merge(met: pa.Table) -> pa.Table:
        runs = [np.frombuffer(x, ENTRY) for x in met.column("entries").to_pylist()]
        return pa.Table.from_batches([run_rows_of([(met.column("at")[0].as_py(), min(met.column("run").to_pylist()), merge_runs(runs))])])

    return map_arrow(runs, cut, RUN_SCHEMA).groupBy("at").applyInArrow(merge, RUN_SCHEMA)


def unpack(runs: DataFrame) -> DataFrame:
    """The entries of runs as rows: (run, digest, bytes, keep_id, keep_row, n)."""
    schema = "run long, digest binary, bytes long, keep_id long, keep_row long, n long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, blob in zip(batch.column("run").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                entries = np.frombuffer(blob, ENTRY)
                for start in range(0, len(entries), 10_000):
                    e = entries[start : start + 10_000]
                    raw = np.stack([e[c] for c in WORDS], axis=1).astype(">u8").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(e), run)), pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), pa.array(e["bytes"]),
                         pa.array(e["id"], mask=e["no_id"].astype(bool)), pa.array(e["row"]), pa.array(e["n"])],
                        names=["run", "digest", "bytes", "keep_id", "keep_row", "n"])

    return map_arrow(runs, rows, schema)


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 100_000, round_bits: int = 2,
                run_rows: int = 50_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256.

    A null text is an empty one. Of rows with equal texts and equal smallest ids one stays. A row without id stays only
    where no equal text has one; its keep_id is then null. Other columns are ignored; an empty table gives no rows.
    The number of partitions is a power of two that follows the number of rows (``range_rows`` entries to a partition
    at most, as digests are even); each round exchanges ``round_bits`` of its bits."""
    ship_package(docs.sparkSession)
    rows = digests(docs, min(run_rows, 1 << ROW_BITS), id_col, text_col)
    total = max(4, (-(-rows.count() // range_rows) - 1).bit_length())
    first = materialise(first_runs(rows, 1 << total), "digest_runs")
    runs = first
    for low in range(0, total, round_bits):
        runs = exchange(runs, low, min(round_bits, total - low), total)
    repeated = unpack(runs).where("n > 1").select("digest", "bytes", "keep_id", "keep_row", F.col("n").alias("group_size"))
    repeated = materialise(repeated, "digest_groups")
    # Answers go back run by run: a digest has one answer in a run, so rows of a hot one stay spread over their runs.
    answers = unpack(first).select("run", "digest", "bytes").join(repeated, ["digest", "bytes"]).dropDuplicates(["run", "digest", "bytes"])
    joined = rows.join(answers, ["run", "digest", "bytes"], "left")
    single = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (single | (F.col("keep_row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
