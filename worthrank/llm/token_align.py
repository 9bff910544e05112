"""Alignment of two tokenizers over a corpus, with corpus counts of linked id pairs.

Both tokenizers cut the same bytes, so the merged token ends of a document cut it into segments that each lie in one token
of either: a segment is a link, and an end of both closes a group. A first pass collects each task's distinct id pairs with
counts. The distinct pairs of the corpus, in buckets by hash, get a minimal perfect hash; a task's counts become dense
vectors indexed by it (every pair's key is verified), and the vectors are summed up a tree. A second pass aligns the documents
again and looks every link up in the function, whose stored keys are verified too.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthrank.llm.common import map_arrow, materialise, text_batches
from worthrank.llm.packing import LONG_GAP, _GAP, byte_bpe_encoder
from worthrank.llm.perfect_hash import PerfectHash, bucket_of
from worthrank.session import ship_package

#: Segments of text, and characters in them, that a task remembers; characters of texts that are handled together.
SEGMENTS, SEGMENT_CHARS, BATCH_CHARS = 300_000, 20_000_000, 2_000_000
#: Characters of new segments that are tokenised together: longer texts take more time a character.
JOINED_CHARS = 20_000
#: A space between two characters that are no white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")


@dataclass(frozen=True)
class Vocabularies:
    """Files of the byte-level ranks (with pattern, and the tokenizer file of the same vocabulary) and of the piece model."""

    ranks_path: str
    pattern: str
    tokenizer_path: str
    model_path: str


class Aligner:
    """Links the tokens of texts, segment by segment, and remembers segments, as words come again and again.

    If no token of either vocabulary has a space after a character that is no white space, no merge crosses the start of a
    space between two such characters, so both tokenizers have an end there. A text is then cut at these spaces, and
    each segment, with its space in front, is tokenised on its own. Otherwise a text is one segment."""

    def __init__(self, files: Vocabularies):
        import sentencepiece

        self.write_groups = True  # whether ``groups`` is needed
        with open(files.ranks_path, "rb") as f:
            ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
        self.a_bytes = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
        self.encode_a = byte_bpe_encoder(files.ranks_path, files.pattern)
        self.tokenizer_path, self.whole = files.tokenizer_path, None
        self.model = sentencepiece.SentencePieceProcessor(model_file=files.model_path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.cuts = not any(re.search(r"\S ", x.decode("utf-8", "replace")) for v in (self.a_bytes, self.b_bytes) for x in v)
        self.a_len, self.b_len = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.n_b = len(self.b_bytes)
        self._texts: list[str] | None = None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.keys: list[np.ndarray] = []  # the keys of the segments' links, in the order of the segments
        self.groups: list[str] = []  # of each segment: its groups, as in the digested text
        self.numbers = np.zeros((1024, 5), np.int64)  # n_a, n_b, n_groups, n_links, 1 if a byte is lost

    @property
    def full(self) -> bool:
        return len(self.known) > SEGMENTS or self.chars > SEGMENT_CHARS

    def _ids_a(self, text: str) -> list[int]:
        if len(text) >= LONG_GAP and any(m.end() - m.start() >= LONG_GAP for m in _GAP.finditer(text)):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.tokenizer_path)
                self.whole.encode_special_tokens = True
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.encode_a(text)

    def id_texts(self) -> list[str]:
        """Decimal ids with the sign that follows: A ids with a comma and a bar, then B ids with a comma and a semicolon."""
        if self._texts is None:
            self._texts = [f"{i}{s}" for n, signs in ((len(self.a_bytes), ",|"), (self.n_b, ",;")) for i in range(n) for s in signs]
        return self._texts

    def _add(self, segments: list[str], keys: np.ndarray, groups: list[str], numbers: np.ndarray) -> None:
        at = len(self.known)
        self.known.update(zip(segments, range(at, at + len(segments)), strict=True))
        self.chars += sum(map(len, segments))
        self.keys.append(keys)
        self.groups += groups
        while len(self.known) > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
        self.numbers[at : len(self.known)] = numbers

    def _learn(self, segments: list[str]) -> None:
        """Tokenise and link new segments that are joined by single spaces."""
        text = " ".join(segments)
        raw, a, b = (" " + text).encode(), self._ids_a(" " + text), self.model.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw or b"".join(map(self.a_bytes.__getitem__, a)) != raw:
            if len(segments) == 1:
                return self._add(segments, np.zeros(0, np.int64), [""], np.array([[0, 0, 0, 0, 1]]))
            half = len(segments) // 2
            self._learn(segments[:half])
            return self._learn(segments[half:])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        at_a, at_b = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
        at_a[ends_a] = at_b[ends_b] = True
        cuts = np.flatnonzero(at_a | at_b)  # a link ends at each
        is_a, is_b = at_a[cuts], at_b[cuts]
        both = is_a & is_b
        keys = a[np.cumsum(is_a) - is_a] * self.n_b + b[np.cumsum(is_b) - is_b]
        ends = np.cumsum([len(s.encode()) + 1 for s in segments])
        upto = np.stack([np.searchsorted(x, ends, "right") for x in (ends_a, ends_b, cuts[both], cuts)], axis=1)
        upto = np.concatenate([np.zeros((1, 4), np.int64), upto])
        groups: list[str] = []
        if self.write_groups:  # all tokens in the order of the digested text: group by group, A before B
            group = np.cumsum(both) - both
            in_a, in_b = np.bincount(group[is_a]), np.bincount(group[is_b])
            signs = np.empty(len(a) + len(b), np.int64)
            signs[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group[is_a]]] = 2 * a + both[is_a]
            signs[np.arange(len(b)) + np.cumsum(in_a)[group[is_b]]] = 2 * (len(self.a_bytes) + b) + both[is_b]
            written = list(map(self.id_texts().__getitem__, signs.tolist()))
            groups = ["".join(written[p:q])[:-1] for p, q in pairwise((upto[:, 0] + upto[:, 1]).tolist())]
        self._add(segments, keys, groups, np.concatenate([np.diff(upto, axis=0), np.zeros((len(segments), 1), np.int64)], axis=1))

    def segments(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all segments of the texts, in order, and how many each text has. A text that is null, empty or loses
        a byte has none."""
        split = [(_CUT.split(text) if self.cuts else [text]) if text else [] for text in texts]
        joined, size = [], 0
        for s in dict.fromkeys(chain.from_iterable(split)):
            if s in self.known:
                continue
            if not self.cuts or s[0].isspace() or s[-1].isspace():
                self._learn([s])
                continue
            joined.append(s)
            size += len(s)
            if size > JOINED_CHARS:
                self._learn(joined)
                joined, size = [], 0
        if joined:
            self._learn(joined)
        out = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
        counts = np.array(list(map(len, split)), np.int64)
        lost = sums(self.numbers[out, 4], counts) > 0
        if lost.any():
            out = out[~np.repeat(lost, counts)]
            counts[lost] = 0
        return out, counts


@lru_cache(1)
def aligner_of(files: Vocabularies) -> Aligner:
    """One to a Python worker: its tables are read once, whatever the number of tasks."""
    return Aligner(files)


def fresh_aligner(files: Vocabularies, write_groups: bool) -> Aligner:
    aligner = aligner_of(files)
    aligner.forget()
    aligner.write_groups = write_groups
    return aligner


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of as many values at a time as ``counts`` says."""
    upto = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[upto[1:]] - total[upto[:-1]]


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Small batches of (…, text) with their texts; the text is the last column."""
    for batch in text_batches(batches):
        texts = batch.column(batch.num_columns - 1).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= BATCH_CHARS or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


PAIR_SCHEMA = "bucket int, node long, keys binary, counts binary"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def count_pairs(docs: DataFrame, files: Vocabularies, buckets: int) -> DataFrame:
    """First pass: each task's distinct id pairs with counts, by bucket; node is the task's number. Written to shared storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        aligner, seen = fresh_aligner(files, False), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            keys, times = np.concatenate([np.zeros(0, np.int64), *aligner.keys]), np.repeat(seen, aligner.numbers[: len(seen), 3])
            own, place = np.unique(keys[times > 0], return_inverse=True)
            n = np.zeros(len(own), np.int64)
            np.add.at(n, place, times[times > 0])
            bucket = bucket_of(own, buckets)
            return _batch(PAIR_SCHEMA, [(g, task, own[bucket == g].tobytes(), n[bucket == g].tobytes()) for g in np.unique(bucket).tolist()])

        for _, texts in small_batches(batches):
            own, _ = aligner.segments(texts)
            seen = np.concatenate([seen, np.zeros(len(aligner.known) - len(seen), np.int64)]) + np.bincount(own, minlength=len(aligner.known))
            if aligner.full:
                yield rows()
                aligner.forget()
                seen = np.zeros(0, np.int64)
        yield rows()
        aligner.forget()

    return materialise(map_arrow(docs.select("text"), run, PAIR_SCHEMA), "id_pairs")


def _last_node(df: DataFrame) -> int:
    return int(df.agg(F.max("node")).first()[0] or 0)


SET_SCHEMA = "bucket int, node long, keys binary"
HASH_SCHEMA = "bucket int, n long, sizes binary, words binary, keys binary"


def build_hash(pairs: DataFrame, fan_in: int) -> DataFrame:
    """(bucket, n, sizes, words, keys): the perfect hash of every bucket's distinct pairs, with the keys in the order of their
    numbers. Sets of keys are united up a tree, ``fan_in`` at a time."""

    def united(met: pa.Table) -> np.ndarray:
        return np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in met.column("keys").to_pylist()]))

    def unite(met: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(SET_SCHEMA, [(met.column("bucket")[0].as_py(), met.column("node")[0].as_py(), united(met).tobytes())])])

    def build(met: pa.Table) -> pa.Table:
        keys = united(met)
        function = PerfectHash.build(keys)
        held = np.empty(len(keys), np.int64)
        held[function.number(keys)] = keys
        return pa.Table.from_batches([_batch(HASH_SCHEMA, [(met.column("bucket")[0].as_py(), len(keys), *function.pack(), held.tobytes())])])

    sets, last = pairs.select("bucket", "node", "keys"), _last_node(pairs)
    while last >= fan_in:
        sets = sets.withColumn("node", F.floor(F.col("node") / fan_in)).groupBy("bucket", "node").applyInArrow(unite, SET_SCHEMA)
        last //= fan_in
    return materialise(sets.groupBy("bucket").applyInArrow(build, HASH_SCHEMA), "pair_hash")


VECTOR_SCHEMA = "bucket int, node long, counts binary"


def count_vectors(pairs: DataFrame, hashes: DataFrame, fan_in: int) -> DataFrame:
    """(bucket, counts): per bucket the dense vector of the corpus counts in the order of the hash. ``fan_in`` tasks' counts go
    into one vector; vectors are then summed up a tree."""

    def dense(met: pa.Table, function: pa.Table) -> pa.Table:
        held, kept = PerfectHash.unpack(function.column("sizes")[0].as_py(), function.column("words")[0].as_py()), np.frombuffer(function.column("kept")[0].as_py(), np.int64)
        out = np.zeros(held.n, np.int64)
        for keys, counts in zip(met.column("keys").to_pylist(), met.column("counts").to_pylist(), strict=True):
            own = np.frombuffer(keys, np.int64)
            at = held.number(own)
            if (at < 0).any() or (kept[at] != own).any():
                raise ValueError("a counted pair is not in the hash")
            out[at] += np.frombuffer(counts, np.int64)
        return pa.Table.from_batches([_batch(VECTOR_SCHEMA, [(met.column("bucket")[0].as_py(), met.column("node")[0].as_py(), out.tobytes())])])

    def add(met: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in met.column("counts").to_pylist())
        return pa.Table.from_batches([_batch(VECTOR_SCHEMA, [(met.column("bucket")[0].as_py(), met.column("node")[0].as_py(), total.tobytes())])])

    up = F.floor(F.col("node") / fan_in)
    first = pairs.withColumn("node", up)
    nodes = first.select(F.col("bucket").alias("own"), F.col("node").alias("at")).distinct()
    functions = nodes.join(hashes, F.col("own") == F.col("bucket")).select("own", "at", "sizes", "words", F.col("keys").alias("kept"))
    vectors = first.groupBy("bucket", "node").cogroup(functions.groupBy("own", "at")).applyInArrow(dense, VECTOR_SCHEMA)
    last = _last_node(pairs) // fan_in
    while last:
        vectors, last = vectors.withColumn("node", up).groupBy("bucket", "node").applyInArrow(add, VECTOR_SCHEMA), last // fan_in
    return vectors.select("bucket", "counts")


def best_counts(counted: DataFrame, n_b: int) -> np.ndarray:
    """The highest count of any pair with each B id; as long as the vocabulary, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(n_b, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.maximum.at(best, np.frombuffer(keys, np.int64) % n_b, np.frombuffer(counts, np.int64))
        ids = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best[ids])], names=["b", "best"])

    rows = map_arrow(counted.select("keys", "counts"), run, "b long, best long").groupBy("b").agg(F.max("best").alias("best")).collect()
    out = np.zeros(n_b, np.int64)
    for r in rows:
        out[r.b] = r.best
    return out


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def look_up(docs: DataFrame, files: Vocabularies, table: DataFrame, best: np.ndarray, buckets: int, shard: list[int], digests: bool) -> DataFrame:
    """Second pass over the pairs of the buckets in ``shard``; adds ``key`` (of the row's id and text) to RESULT."""
    held = {r.bucket: r for r in table.where(F.col("bucket").isin(shard)).collect()}
    function = PerfectHash.join({g: PerfectHash.unpack(r.sizes, r.words) for g, r in held.items()}, buckets)
    keys, counts = (np.frombuffer(b"".join(r[c] for r in held.values()), np.int64) for c in ("keys", "counts"))
    shared = docs.sparkSession.sparkContext.broadcast((function.sizes, function.starts, function.words, keys, counts, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, starts, words, keys, counts, best = shared.value
        function, aligner = PerfectHash(sizes, starts, words), fresh_aligner(files, digests)

        def per_segment(first: int) -> np.ndarray:
            """n_best and count_sum of the segments from number ``first`` on."""
            links, own = aligner.numbers[first : len(aligner.known), 3], np.concatenate([np.zeros(0, np.int64), *aligner.keys])
            aligner.keys.clear()
            at = function.number(own)
            found = at >= 0
            found[found] = keys[at[found]] == own[found]
            count = np.zeros(len(at), np.int64)
            count[found] = counts[at[found]]
            return np.stack([sums(found & (count == best[own % aligner.n_b]), links), sums(count, links)], axis=1)

        held = np.zeros((0, 2), np.int64)
        for batch, texts in small_batches(batches):
            own, n = aligner.segments(texts)
            held = np.concatenate([held, per_segment(len(held))])
            digest, at = [None] * len(texts), 0
            if digests:
                order = own.tolist()
                for i, k in enumerate(n.tolist()):
                    digest[i] = hashlib.sha256(";".join(map(aligner.groups.__getitem__, order[at : at + k])).encode()).hexdigest() if k else ""
                    at += k
            numbers = [*aligner.numbers[own, :4].T, *held[own].T]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(sums(x, n)) for x in numbers), pa.array(digest, pa.string()), batch.column(1)],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "key"])
            if aligner.full:
                aligner.forget()
                held = held[:0]
        aligner.forget()

    return map_arrow(docs.select("doc_id", "key", "text"), run, RESULT + ", key string")


def align_tokenizers(docs: DataFrame, files: Vocabularies, id_col: str = "doc_id", text_col: str = "text", buckets: int = 128,
                     shard_pairs: int = 16_000_000, fan_in: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null, empty or not kept byte by byte by both tokenizers have zeros and an empty string. Repeated rows
    are rows of their own and count as such; other columns are ignored; an empty table gives no rows. A task holds
    a text whole. The hash with its keys and counts reaches the tasks in shards of whole buckets, ``shard_pairs`` pairs (16 bytes
    each and 4 bits) at most or a single bucket; each shard is a pass over the documents, and their sums are added."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pairs = count_pairs(rows, files, buckets)
    hashes = build_hash(pairs, fan_in)
    counted = materialise(hashes.join(count_vectors(pairs, hashes, fan_in), "bucket"), "pair_counts")
    best = best_counts(counted, aligner_of(files).n_b)
    shards: list[list[int]] = [[]]
    size = 0
    for r in sorted(counted.select("bucket", "n").collect()):
        if shards[-1] and size + r.n > shard_pairs:
            shards.append([])
            size = 0
        shards[-1].append(r.bucket)
        size += r.n
    if len(shards) == 1:
        return look_up(rows.withColumn("key", F.lit(None).cast("string")), files, counted, best, buckets, shards[0], True).drop("key")
    keyed = rows.withColumn("key", F.concat_ws(" ", F.col("doc_id").cast("string"), F.sha2(F.col("text").cast("binary"), 256)))
    first = look_up(keyed, files, counted, best, buckets, shards[0], True)
    more = None
    for shard in shards[1:]:  # equal rows have equal sums: one of them answers for all
        part = look_up(keyed.dropDuplicates(["key"]), files, counted, best, buckets, shard, False).select("key", "n_best", "count_sum")
        more = part if more is None else more.unionByName(part)
    more = more.groupBy("key").agg(F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_sum"))
    joined = first.join(more, "key")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.col("more_best")).alias("n_best"),
                         (F.col("count_sum") + F.col("more_sum")).alias("count_sum"), "groups_sha256")
