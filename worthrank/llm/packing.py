"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised where they are read. Only the narrow list of pieces is shuffled, into many
buckets of a bounded expected size, and each bucket is packed on its own by bounded-space online
best fit: a fixed number of open bins kept in a bitset keyed by free space. A piece goes into the
open bin that it fills most; when the limit of open bins is reached, the fullest bin closes first.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthrank.llm.common import map_arrow, materialise, text_batches
from worthrank.session import ship_package

END_ID = 0
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


#: White space in one run from which texts go to ``tokenizers``: tiktoken's pattern matcher fails between 0.7 and 1 million.
LONG_GAP = 100_000
_GAP = re.compile(r"\s+")


def byte_bpe_encoder(ranks_path: str, pattern: str, tokenizer_path: str | None = None) -> Callable[[str], list[int]]:
    """An encoder over a file of byte-pair ranks, with the added tokens of the tokenizer file of the same vocabulary.
    Without that file strings of special tokens are ordinary text, and texts with a run of white space of a million fail."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if tokenizer_path is None:
        return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    with open(tokenizer_path, "rb") as f:
        held = f.read()
    added = {t["content"]: t["id"] for t in json.loads(held)["added_tokens"]}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    whole: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_GAP and any(m.end() - m.start() >= LONG_GAP for m in _GAP.finditer(text)):
            whole[:] = whole or [Tokenizer.from_buffer(held)]
            return whole[0].encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all")

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full pieces, after a first one that may be shorter."""
    first = n % capacity
    pieces = [(0, first)] if first else []
    return pieces + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, tokenizer_path: str | None = None) -> DataFrame:
    """Tokenise whole texts, end each with id 0 and cut those longer than ``capacity``. With ``tokenizer_path`` the
    ids are those of that tokenizer without its special tokens added, also for texts that hold them.

    Returns one row per piece: doc_id, piece (from 0), start (the document's ids before it), length,
    ids_crc32 (of the little-endian unsigned 32-bit ids) and, if ``with_ids``, those bytes as ids
    (else null). A null or empty text is the end id alone. Repeated rows give repeated pieces; other
    columns of ``docs`` are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe_encoder(ranks_path, pattern, tokenizer_path)
        end = array("I", [END_ID])
        for batch in text_batches(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (array("I", encode(text or "")) + end).tobytes()
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, k, start, length, zlib.crc32(own), own if with_ids else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, PIECE_SCHEMA)


class OpenBins:
    """Bounded-space online best fit. ``place`` returns (bin, offset) for a length up to capacity."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins with that much free space
        self.bits = 0  # bit f is set if by_free[f] has a bin
        self.opened = self.open = 0

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        found = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:  # the lowest set bit: the least free space that is enough
            free = length + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            found, free = self.opened, self.capacity
            self.opened += 1
        left = free - length
        if left:
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.capacity - free


def pack(lengths: list[int], capacity: int, open_bins: int, window: int) -> tuple[list[int], list[int]]:
    """Bins and offsets for a stream of lengths, met in windows that are each sorted by falling length."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    state = OpenBins(capacity, open_bins)
    for at in range(0, len(lengths), window):
        for i in sorted(range(at, min(at + window, len(lengths))), key=lambda i: -lengths[i]):
            bins[i], offsets[i] = state.place(lengths[i])
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = 2048, open_bins: int = 1024, window: int = 4096,
                bucket_pieces: int = 8192) -> DataFrame:
    """Pack the rows of ``token_pieces`` into sequences; adds sequence_id and offset to each row.

    ``pieces`` is written once to shared storage, because its count sets the number of buckets; a
    bucket is chosen by a hash of the piece, so buckets stay near ``bucket_pieces`` rows whatever the
    sources or copies. sequence_id holds the bucket in its upper bits: it depends on the data alone,
    not on the task that packs, so a retried task gives the same result. An empty table gives none."""
    ship_package(pieces.sparkSession)
    held = materialise(pieces, "pieces")
    buckets = max(1, -(-held.count() // bucket_pieces))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    narrow = held.select("doc_id", "piece", "start", "length", "ids_crc32",
                         order.alias("o"), F.pmod(order, F.lit(buckets)).alias("bucket"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["o", "doc_id", "piece"], kind="stable", ignore_index=True)
        bins, offsets = pack(group["length"].tolist(), capacity, open_bins, window)
        group["sequence_id"] = (group["bucket"].to_numpy(np.int64) << 32) + np.array(bins, np.int64)
        group["offset"] = np.array(offsets, np.int64)
        return group.drop(columns=["o", "bucket"])

    return narrow.groupBy("bucket").applyInPandas(
        one, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
