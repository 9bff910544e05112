"""Exact Jaccard join on word shingles through parity sketches.

The shingles of a document are XORed into a bit sketch: each flips one bit, so the Hamming distance of two
sketches is at most the symmetric difference of the sets. Two sets of a and b shingles with a similarity
of 3/4 or more differ in d = (a + b) / 7 at most. Within a band of sizes the sketch is cut into more parts
than that d; by the pigeonhole principle some part of two similar sets has no differing shingle. A
part's shingles are also XORed into a 64-bit word, and documents of a band that agree in a part's word are
candidates. Of the words that it shares with any similar set at least, a set leaves out half before the shuffle, the
same ones in all sets by a fixed order of the words. Candidates whose sketches lie too far apart are dropped, the rest
is verified on the shingles.

Groups of copies aren't expanded into pairs. Equal sets are one class from the start: they have one name, a 64-bit
sum over the set, and candidates are pairs of names. Of the sets that
agree in a word, small groups are compared in full and large ones with one of their documents; when the
links found are known, the large groups that still span several components are compared in full across
components, in blocks; a document leaves its most frequent groups out as far as it must meet its links in others. So no link that could join two components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worthrank.llm.common import map_arrow, materialise, release_shuffles
from worthrank.llm.shingles import Words, byte_slices, packed6, runs_of, scramble, unpacked6

SHINGLE = 5
BLOCK = 1024
_PART = np.uint64(0xD6E8FEB86659FD93)
_CLASS = np.uint64(0xA0761D6478BD642F)
_EMPTY = np.uint64(0x2545F4914F6CDD1D)
_ORDER = np.uint64(0x9FB21C651E98DF25)


@cache
def band_parts(least: int, differ: int) -> int:
    """Parts for sets of ``least`` shingles and more that differ in ``differ`` at most: above ``differ``, and enough
    that a set of the least size rarely has as many empty parts as two similar sets have equal ones."""
    parts = differ + 1
    while parts < 4 * (differ + 1):
        empty = parts * math.exp(-least / parts)
        if parts - differ > empty + 3 * math.sqrt(empty):
            break
        parts += 1
    return parts


def bands(size: int) -> list[tuple[int, int, int]]:
    """(band, parts, largest difference) of the one to three bands in which a set of ``size`` shingles is compared.

    Bands 2j hold the sizes from 2^j up to 2^(j+1); a band 2j + 1 holds the pairs across 2^(j+1)."""
    j = size.bit_length() - 1
    low, high = 1 << j, 2 << j
    differ = (2 * (high - 1)) // 7
    found = [(2 * j, band_parts(low, differ), differ)]
    for at, k in ((low, j - 1), (high, j)):  # sizes s below at and t from at on, with 4 s >= 3 t
        if (4 * size >= 3 * at) if size < at else (3 * size <= 4 * (at - 1)):
            differ = (7 * (at - 1) // 3) // 7
            found.append((2 * k + 1, band_parts(-(-3 * at // 4), differ), differ))
    return found


class ShingleSets:
    """The distinct shingle hashes of the rows of a binary Arrow column: row and hash, ordered by both."""

    def __init__(self, column: pa.Array):
        words = Words(column, fold_case=True)
        starts = words.run_starts(SHINGLE)
        row = words.row_of_word()[starts]
        key = words.runs(SHINGLE)[starts]
        few = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
        for size in range(1, SHINGLE):  # fewer words than a shingle are one shingle
            own = few[words.count[few] == size]
            row = np.concatenate([row, own])
            key = np.concatenate([key, words.runs(size)[words.first[own]]])
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])) if len(row) else np.zeros(0, bool)
        self.row, self.key = row[new], key[new]
        self.size = np.bincount(self.row, minlength=len(column)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])


def sketch_bits(size: np.ndarray) -> np.ndarray:
    """Bits of the sketch of a set: a power of two, at least twice the size and 64."""
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))


def set_sums(sets: ShingleSets, salt: int) -> np.ndarray:
    """A 64-bit sum over the shingles of each row; that of salt 1 names the set."""
    total = np.zeros(len(sets.size), np.uint64)
    np.add.at(total, sets.row, scramble(sets.key + np.uint64(salt)))
    return total.view(np.int64)


def _rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).where("doc_id is not null")


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, s1, s2, sketch): set size, two 64-bit sums that name the set, and its parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 1):
            sets = ShingleSets(part.column(1))
            sums = [set_sums(sets, salt) for salt in (1, 2)]
            bits = sketch_bits(sets.size)
            base = np.concatenate([[0], np.cumsum(bits)])
            at = base[sets.row] + (sets.key & (bits[sets.row] - 1).astype(np.uint64)).astype(np.int64)
            odd = np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little")
            sketches = [odd[base[i] // 8 : base[i + 1] // 8].tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets.size), pa.array(sums[0]), pa.array(sums[1]), pa.array(sketches, pa.binary())],
                                             names=["doc_id", "n", "s1", "s2", "sketch"])

    return map_arrow(_rows_of(docs, id_col, text_col), run, "doc_id long, n long, s1 long, s2 long, sketch binary")


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the longer one folded to the length of the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def part_words(sets: ShingleSets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key) for the parts of every band that a row is compared in, and by row and ``_slot`` of the band how
    many of these keys it shares at least with any set that it links with. The slot is in a key's lowest two bits.

    Of s keys that a row shares at least it leaves out (s - 1) // 2, the last ones in one order of all keys. Two sets
    leave out the last of those that they share, so of c >= s shared ones c - (c - 1) // 2 >= s - (s - 1) // 2 remain."""
    rows_out, keys_out = [], []
    shared = np.zeros((len(sets.size), 4), np.int64)
    found = {int(n): bands(int(n)) for n in np.unique(sets.size) if n}
    for k in range(3):
        band, parts, differ = (np.array([found[n][k][i] if n and len(found[n]) > k else 0 for n in sets.size.tolist()], np.int64) for i in range(3))
        use = parts[sets.row] > 0
        row, key = sets.row[use], sets.key[use]
        if not len(row):
            continue
        base = np.concatenate([[0], np.cumsum(parts)])
        part = ((key >> np.uint64(32)) * parts[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        at = base[row] + part
        word = np.zeros(int(base[-1]), np.uint64)
        np.bitwise_xor.at(word, at, scramble(key ^ _EMPTY))
        filled = np.bincount(at, minlength=len(word)) > 0
        owner = np.repeat(np.arange(len(parts)), parts)
        empty = np.bincount(owner[~filled], minlength=len(parts))
        slot = _slot(band)
        used = np.flatnonzero(parts)
        shared[used, slot[used]] = np.clip(parts - differ - empty, 0, 2**15 - 1)[used]
        # a set with as many empty parts as two similar sets may have equal ones is also found by its empty parts
        keep = filled | (empty >= parts - differ)[owner]
        number = (np.arange(len(word)) - base[owner]).astype(np.uint64)
        keys = scramble(np.where(filled, word, _EMPTY) + number * _PART + band[owner].astype(np.uint64) * _CLASS)
        keys = keys & ~np.uint64(3) | slot[owner].astype(np.uint64)
        row, keys = owner[keep], keys[keep]
        mine = shared[np.arange(len(parts)), slot] * (parts > 0)
        surplus = np.maximum(mine - 1, 0) // 2
        shared[used, slot[used]] -= surplus[used]
        order = np.lexsort((scramble(keys ^ _ORDER), row))
        row, keys = row[order], keys[order]
        end = np.searchsorted(row, np.arange(len(parts)), side="right")
        stays = np.arange(len(row)) < (end - surplus)[row]
        rows_out.append(row[stays])
        keys_out.append(keys[stays])
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), shared
    return np.concatenate(rows_out), np.concatenate(keys_out), shared


def _slot(band: np.ndarray) -> np.ndarray:
    """A number below 4 that differs for the bands of one set."""
    return (band & 1) | ((band >> 1) & 1) << 1


#: Four counts of up to 15 bits in one number.
_SLOT_PLACE = np.array([1 << (15 * k) for k in range(4)], np.int64)
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
PACKED_SCHEMA = "bucket int, kind int, keys binary, a binary, b binary"
_FOUND = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
FOUND_SCHEMA = "kind int, bucket int, a binary, b binary"
EDGES, MEMBERS, SHARED, KEYS, LARGE = 0, 1, 2, 3, 4
HELD_PAIRS = 2_000_000


def _by_key(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The order by key and, within a key, by one of sixteen shuffles of the documents that the key chooses. So the
    first documents of the large groups that a document is in, which it is compared with, differ."""
    return np.lexsort((docs, scramble(docs.view(np.uint64) + (keys & np.uint64(15)) * _PART), keys))


def _groups(keys: np.ndarray, docs: np.ndarray, large: np.ndarray, small_group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (a, b) of the groups of equal keys, (key, doc) of the large groups, and which entries stand for
    their group: all of a small one, the first document of a large one. Entries come in the order of ``_by_key``."""
    at = runs_of(keys)
    count = np.diff(np.append(at, len(keys)))
    group = np.repeat(np.arange(len(at)), count)
    is_large = (count > small_group) | (np.logical_or.reduceat(large, at) if len(at) else np.zeros(0, bool))
    inside = is_large[group]
    a, b = [docs[at[group]][inside]], [docs[inside]]
    for step in range(1, small_group):
        i = np.arange(len(keys) - step) if len(keys) > step else np.zeros(0, np.int64)
        i = i[(group[i] == group[i + step]) & ~inside[i]]
        a.append(docs[i])
        b.append(docs[i + step])
    a, b = np.concatenate(a), np.concatenate(b)
    other = a != b
    first = np.zeros(len(keys), bool)
    first[at] = True
    return a[other], b[other], keys[inside], docs[inside], ~inside | first


def candidates(docs: DataFrame, bits: int, small_group: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows of candidate pairs (EDGES: names of sets a, b, by bucket of the pair), of the members of large groups
    (MEMBERS: key a, set b) and of the keys that sets share with any that they link with (SHARED: set a, counts by slot
    b), all as little-endian 64-bit numbers. A task meets several hash ranges and reports a pair once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 1):
            sets = ShingleSets(part.column(1))
            names = set_sums(sets, 1)
            row, keys, shared = part_words(sets)
            of = names[row]
            order = _by_key(keys, of)
            keys, of = keys[order], of[order]
            same = _repeated(keys, of)
            keys, of = keys[~same], of[~same]
            at = runs_of(keys)
            count = np.diff(np.append(at, len(keys)))
            big = np.repeat(count > small_group, count)  # of groups that are large within the slice only the smallest goes on
            a, b, m_keys, m_docs, _ = _groups(keys[big], of[big], np.zeros(int(big.sum()), bool), small_group)
            m_keys = _met(m_keys, _buckets(m_keys, bits))
            first = np.zeros(len(keys), bool)
            first[at] = True
            rows = []
            for kind, use in ((KEYS, ~big), (LARGE, big & first)):
                rows += _keyed_rows(kind, keys[use], of[use], bits)
            if len(a):
                rows.append((int(a[0]) % 2**bits, EDGES, None, *(x.astype("<i8").tobytes() for x in _pairs(a, b))))
            _, one = np.unique(names, return_index=True)
            one = one[sets.size[one] > 0]
            if len(one):
                rows.append((int(names[one[0]]) % 2**bits, SHARED, None, names[one].astype("<i8").tobytes(), (shared[one] @ _SLOT_PLACE).astype("<i8").tobytes()))
            if len(m_keys):
                rows.append((int(m_docs[0]) % 2**bits, MEMBERS, None, m_keys.astype("<u8").tobytes(), m_docs.astype("<i8").tobytes()))
            yield _batch(rows, _PACKED)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, edges = None, [], HeldPairs(bits)

        def close() -> list[tuple]:
            if not held:
                return []
            keys, of, large = (np.concatenate([h[k] for h in held]) for k in range(3))
            order = _by_key(keys, of)
            keys, of, large = keys[order], of[order], large[order]
            new = np.flatnonzero(~_repeated(keys, of))  # copies in other slices
            a, b, m_keys, m_docs, _ = _groups(keys[new], of[new], np.logical_or.reduceat(large, new), small_group)
            edges.add(a, b)
            return [(MEMBERS, 0, m_keys.astype("<u8").tobytes(), m_docs.astype("<i8").tobytes())] if len(m_keys) else []

        for batch in batches:
            out = []
            for own, kind, keys, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != bucket:
                    out += close()
                    bucket, held = own, []
                if kind == EDGES:
                    edges.add(np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"))
                elif kind in (MEMBERS, SHARED):
                    out.append((kind, 0, a, b))
                else:
                    of = np.repeat(np.frombuffer(a, "<i8"), np.frombuffer(b, "<u4"))
                    held.append((_met(unpacked6(keys), np.int64(own)), of, np.full(len(of), kind == LARGE)))
                if edges.full():
                    out += edges.rows()
            yield _batch(out, _FOUND)
        yield _batch(close() + edges.rows(), _FOUND)

    packed = map_arrow(_rows_of(docs, id_col, text_col), emit, PACKED_SCHEMA)
    tasks = min(2**bits, max(2**bits // 8, 2 * docs.sparkSession.sparkContext.defaultParallelism))
    dealt = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind")
    return map_arrow(dealt, meet, FOUND_SCHEMA)


def _repeated(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which entries equal the one before."""
    return np.append(False, (keys[1:] == keys[:-1]) & (of[1:] == of[:-1])) if len(keys) else np.zeros(0, bool)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, the smaller number first, in order."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = ~_repeated(low, high)
    return low[new], high[new]


class HeldPairs:
    """The distinct pairs that a task has found, given out as packed rows by 2^bits buckets of the pair."""

    def __init__(self, bits: int):
        self.bits, self.held, self.count, self.added = bits, [], 0, 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.held.append((a, b))
            self.added += len(a)
            if self.added >= HELD_PAIRS:
                self._merge()

    def _merge(self) -> None:
        self.held = [_pairs(*(np.concatenate([h[k] for h in self.held]) for k in (0, 1)))] if self.held else []
        self.count, self.added = sum(len(h[0]) for h in self.held), 0

    def full(self) -> bool:
        return self.count >= HELD_PAIRS

    def rows(self) -> list[tuple]:
        self._merge()
        if not self.held:
            return []
        (low, high), self.held, self.count = self.held[0], [], 0
        buckets = _buckets(scramble(low.view(np.uint64) * _PART + high.view(np.uint64)), self.bits)
        order = np.argsort(buckets, kind="stable")
        low, high, buckets = low[order], high[order], buckets[order]
        cuts = np.append(runs_of(buckets), len(low))
        return [(EDGES, int(buckets[i]), low[i:j].astype("<i8").tobytes(), high[i:j].astype("<i8").tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def distinct_pairs(found: DataFrame, bits: int) -> DataFrame:
    """(a, b): every pair of the packed EDGES rows once. All reports of a pair are in one of the 2^bits buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, HeldPairs(0)

        def close() -> Iterator[pa.RecordBatch]:
            for _, _, a, b in held.rows():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8")) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            for own, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != bucket:
                    yield from close()
                    bucket = own
                held.add(np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"))
        yield from close()

    tasks = min(2**bits, max(2**bits // 8, 2 * found.sparkSession.sparkContext.defaultParallelism))
    dealt = found.where(F.col("kind") == EDGES).select("bucket", "a", "b").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return map_arrow(dealt, run, "a long, b long")


def _buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _met(keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The keys as they are where the slices meet, which name the groups of all slices: the lowest 48 bits below the bucket."""
    return keys & np.uint64(2**48 - 1) | (bucket & 2**16 - 1).astype(np.uint64) << np.uint64(48)


def _keyed_rows(kind: int, keys: np.ndarray, of: np.ndarray, bits: int) -> list[tuple]:
    buckets = _buckets(keys, bits)
    order = np.lexsort((of, buckets))
    keys, of, buckets = keys[order], of[order], buckets[order]
    cuts = np.append(runs_of(buckets), len(keys))
    rows = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        at = runs_of(of[i:j])
        rows.append((int(buckets[i]), kind, packed6(keys[i:j]), of[i:j][at].astype("<i8").tobytes(), np.diff(np.append(at, j - i)).astype("<u4").tobytes()))
    return rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def unpack_pairs(found: DataFrame, kind: int, names: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8")) for x in (a, b)], names=list(names))

    return map_arrow(found.where(F.col("kind") == kind).select("a", "b"), run, f"{names[0]} long, {names[1]} long")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, root): for every id in ``links`` (a, b) the smallest id reachable. Alternates the large-star and the
    small-star step, each an aggregation and a join, until the links are stars. After a number of ``rounds`` given, a
    root is some id that is reachable, not always the smallest."""
    stars, last, done = links.select("a", "b").where("a <> b"), None, 0
    while rounds is None or done < rounds:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # now every link points to a smaller id; the small star links all that an id points to with the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        stars = materialise(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
                            .where("a <> b").distinct(), "links")
        done += 1
        if rounds is None:
            now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == last:
                break
            last = now
    # an id that several links point from, before they are stars, takes the smallest
    roots = stars.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
    heads = stars.select(F.col("b").alias("id")).distinct()
    return roots.unionByName(heads.join(roots.select("id"), "id", "left_anti").select("id", F.col("id").alias("root")))


def _near(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """Of pairs (a, b) of names of sets those whose sizes and sketches allow a link, as pairs of documents."""
    left, right = (heads.select(F.col("s1").alias(f"name_{x}"), F.col("cid").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
    both = (edges.toDF("name_a", "name_b").join(left, "name_a").join(right, "name_b").where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
            .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "n_a", "n_b", "s_a", "s_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, n_a, n_b, s_a, s_b = (c.to_pylist() for c in batch.columns)
            ok = [distance(x, y) <= (p + q) // 7 for p, q, x, y in zip(n_a, n_b, s_a, s_b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(both, run, "a long, b long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, keys): the sorted shingle hashes of the documents in ``wanted`` (doc_id, s1), of rows that share an id
    those of a row with the set that ``wanted`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 1):
            sets = ShingleSets(part.column(1))
            named = pa.array(set_sums(sets, 1) == part.column(2).to_numpy(zero_copy_only=False))
            keys = [np.sort(sets.key[i:j] & np.uint64(2**48 - 1)) for i, j in zip(sets.first[:-1], sets.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([packed6(k) for k in keys], pa.binary())], names=["doc_id", "keys"]).filter(named)

    return map_arrow(_rows_of(docs, id_col, text_col).join(wanted, "doc_id"), run, "doc_id long, keys binary").dropDuplicates(["doc_id"])


def _linked(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with 100 * intersection >= 75 * union."""
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("keys").alias(f"k_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = unpacked6(x), unpacked6(y)
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * common >= 75 * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(edges.join(left, "a").join(right, "b").select("a", "b", "k_a", "k_b"), run, "a long, b long")


def _across(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that ``roots`` doesn't put in one component."""
    left, right = (roots.select(F.col("id").alias(x), F.col("root").alias(f"r_{x}")) for x in "ab")
    both = edges.join(left, "a", "left").join(right, "b", "left")
    return both.where(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).select("a", "b")


def rare_members(members: DataFrame, shared: DataFrame) -> DataFrame:
    """The (key, s1) rows but for each set's most frequent keys, one fewer in a band than it shares with any
    set that it links with. The rarest key that two linked sets share is among neither's dropped
    ones, so they still meet; unrelated documents that share a frequent passage mostly don't."""
    counts = members.groupBy("key").agg(F.count("*").alias("g"))
    slot = F.col("key").bitwiseAND(F.lit(3)).cast("int")
    place = Window.partitionBy("s1", "slot").orderBy(F.col("g").desc(), "key")
    least = F.lit(0).cast("long")
    for k in range(4):
        least = F.when(F.col("slot") == k, F.shiftright(F.col("shared"), 15 * k).bitwiseAND(F.lit(2**15 - 1))).otherwise(least)
    return (members.join(counts, "key").withColumn("slot", slot).withColumn("place", F.row_number().over(place))
            .join(shared, "s1").where(F.col("place") >= least).select("key", "s1"))


def _open_groups(members: DataFrame, heads: DataFrame, roots: DataFrame, bits: int) -> DataFrame:
    """Packed EDGES rows of pairs across components in the large groups that span several, compared by sketch in blocks
    of members. A task reports a pair once."""
    rooted = members.join(heads.select("s1", "cid"), "s1").join(roots, F.col("cid") == F.col("id"), "left").select("key", "cid", F.coalesce("root", "cid").alias("root"))
    rooted = materialise(rooted, "members")
    spans = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("g")).where("r0 <> r1")
    blocks = F.ceil(F.col("g") / BLOCK).cast("int")
    own = (rooted.join(spans.select("key", blocks.alias("blocks")), "key").withColumn("i", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
           .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .join(heads.select("cid", "n", "sketch"), "cid")
           .select("key", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "cid", "root", "n", "sketch"))

    def compare(held: list[tuple], pairs: HeldPairs) -> None:
        """Pairs across roots whose sizes and sketches allow a link. A block pair compares its two blocks, or one with itself."""
        if not held:
            return
        i, ids, roots_, sizes = (np.array([h[k] for h in held]) for k in range(4))
        sketches = [np.frombuffer(h[4], np.uint64) for h in held]
        width = min(map(len, sketches))
        flat = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in sketches])
        roots_of, counts = np.unique(roots_, return_counts=True)
        frequent = roots_of[counts.argmax()]
        for x in np.flatnonzero(roots_ != frequent):  # every pair across roots has one outside the most frequent root
            other = (roots_ != roots_[x]) & (4 * np.minimum(sizes, sizes[x]) >= 3 * np.maximum(sizes, sizes[x]))
            other &= (roots_ == frequent) | (ids > ids[x])
            if i.min() != i.max():
                other &= i != i[x]
            y = np.flatnonzero(other)
            far = np.bitwise_count(flat[y] ^ flat[x]).sum(axis=1)
            y = y[far <= (sizes[y] + sizes[x]) // 7]
            pairs.add(np.full(len(y), ids[x]), ids[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, pairs = None, [], HeldPairs(bits)
        for batch in batches:
            for key, p, q, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, p, q) != at:
                    compare(held, pairs)
                    at, held = (key, p, q), []
                held.append(rest)
            if pairs.full():
                yield _batch(pairs.rows(), _FOUND)
        compare(held, pairs)
        yield _batch(pairs.rows(), _FOUND)

    dealt = own.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return map_arrow(dealt, run, FOUND_SCHEMA)


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = 1_500_000,
                   small_group: int = 8) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``.

    Sets are of five-word shingles, words cut at ASCII white space and A-Z in lower case; fewer words are one
    shingle; null or empty texts, or texts without words, have none and no link. Two documents link when 100 *
    intersection >= 75 * union; component_id is the smallest id reachable by links, the own id included. Shingles
    are told apart by 64-bit hashes, of which 48 bits are compared in verification. Groups of up to ``small_group``
    documents are compared in full at once; the result doesn't depend on it. Rows with a null id get a null component; rows that share
    an id and have different texts are one document, with the largest of their sets (of equally large ones that with the larger hash). Other columns are ignored."""
    spark = docs.sparkSession
    signed = materialise(signatures(docs, id_col, text_col), "signatures")
    signed_ids = signed.groupBy("doc_id").agg(F.max(F.struct("n", "s1", "s2", "sketch")).alias("set")).select("doc_id", "set.*")
    some = signed_ids.where("n > 0")
    names = some.groupBy("s1", "s2").agg(F.min("doc_id").alias("cid"))
    # a set that many documents have is one skewed key of a plain join, which adaptive execution splits
    classes = materialise(some.join(names, ["s1", "s2"]).select("doc_id", "cid", "n", "s1", "sketch"), "classes")
    shingles = classes.agg(F.sum("n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1.0, 0.5 * shingles / bucket_keys))))
    found = materialise(candidates(docs, bits, small_group, id_col, text_col), "candidates")
    release_shuffles(spark)
    of = classes.select("doc_id", "cid")
    heads = classes.where("doc_id = cid").select("cid", "s1", "n", "sketch")

    def sets_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        wanted = ids.join(heads, "cid").select(F.col("cid").alias("doc_id"), "s1")
        return materialise(shingle_sets(docs, wanted, id_col, text_col), "sets")

    pending = materialise(_near(distinct_pairs(found, bits), heads), "pairs")
    sets = sets_of(pending)
    release_shuffles(spark)
    # first one pair for every document, then those that are still across components
    links = materialise(_linked(pending.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets), "links")
    rest = _across(pending, materialise(components(links, rounds=1), "roots"))
    links = links.unionByName(materialise(_linked(rest, sets), "links"))
    roots = materialise(components(links), "roots")
    members = rare_members(unpack_pairs(found, MEMBERS, ("key", "s1")).distinct(), unpack_pairs(found, SHARED, ("s1", "shared")).dropDuplicates(["s1"]))
    more = materialise(distinct_pairs(_open_groups(members, heads, roots, bits), bits), "pairs")
    if not more.isEmpty():
        links = links.unionByName(materialise(_linked(more, sets_of(more)), "links"))
    # the roots found so far shorten the paths
    links = roots.select(F.col("root").alias("a"), F.col("id").alias("b")).unionByName(links)
    roots = materialise(components(links), "roots")
    release_shuffles(spark)
    rooted = of.join(roots.select(F.col("id").alias("cid"), "root"), "cid", "left").select(F.col("doc_id").alias("id"), F.coalesce("root", "cid").alias("root"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    sizes = signed.groupBy("doc_id").agg(F.max("n").alias("n"))
    return (ids.join(sizes, "doc_id", "left").join(rooted, F.col("doc_id") == F.col("id"), "left")
            .select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id")))
