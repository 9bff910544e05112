import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tests.llm.fixtures import documents, spark_documents
from tokenizers import Tokenizer

from worthrank.llm.perfect_hash import PerfectHash, bucket_of
from worthrank.llm.queries import ALIGNED, LLM_QUERIES
from worthrank.llm.token_align import Aligner, align_tokenizers, sums

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def byte_table():
    """The bytes behind the characters of a byte-level vocabulary: printable ones stand for themselves, the rest for 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in own}
    return table | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def brute(rows):
    tok = Tokenizer.from_file(ALIGNED.tokenizer_path)
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=ALIGNED.model_path)
    of = byte_table()
    cut, total = [], Counter()
    for _, text in rows:
        a = [] if not text else tok.encode(" " + text, add_special_tokens=False).ids
        b = [] if not text else model.encode(text)
        a_bytes = [bytes(of[c] for c in tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text and not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            a, b = [], []
        links, groups, i, j, ea, eb, ga, gb = [], [], 0, 0, 0, 0, [], []
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            left, right = ea + len(a_bytes[i]), eb + len(b_bytes[j])
            if left <= right:
                ga.append(a[i])
            if right <= left:
                gb.append(b[j])
            if left == right:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
            if left <= right:
                i, ea = i + 1, left
            if right <= left:
                j, eb = j + 1, right
        cut.append((a, b, links, groups))
        total.update(links)
    best = {}
    for (_, b), n in total.items():
        best[b] = max(best.get(b, 0), n)
    return [(doc, len(a), len(b), len(groups), len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for (doc, _), (a, b, links, groups) in zip(rows, cut, strict=True)]


def order(rows):
    return sorted((tuple(r[c] for c in COLUMNS) if not isinstance(r, tuple) or hasattr(r, "doc_id") else r for r in rows), key=repr)


ODD = ["<|endoftext|> a <s> </s> <unk> <0x41>", "x▁y", "▁", "emoji 😀😀 中文字 日本 ñ́", "a\x00b\x01", "﻿bom", "tabs\t\t\n\n  end ", " ", "   ", "z" * 5000,
       " " * 150_000 + "end", "\r\n\r\n", "²³ ½ ﬁ Å", "hello" * 3]


def test_alignment_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in documents(40)] + [(900 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, "no id"), (901, "same id"), (5, None)]
    docs = spark.createDataFrame([(t, "k", 1, i) for i, t in rows], "text string, key string, bucket int, doc_id long").repartition(5)
    expected = order(brute(rows))
    assert order(align_tokenizers(docs, ALIGNED).collect()) == expected
    assert order(align_tokenizers(docs, ALIGNED, buckets=4, shard_pairs=100, fan_in=2).collect()) == expected


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert order(LLM_QUERIES["op12_token_alignment"](spark, sf).collect()) == order(brute(rows))


def test_empty_table_and_texts_without_tokens(spark):
    assert align_tokenizers(spark_documents(spark, []), ALIGNED).count() == 0
    got = align_tokenizers(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), ALIGNED).collect()
    assert order(got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_numbers_keys_without_gaps(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 60, n))
    assert sorted(PerfectHash.build(keys).number(keys)) == list(range(len(keys)))
    bucket = bucket_of(keys, 7)
    parts = {g: PerfectHash.unpack(*PerfectHash.build(keys[bucket == g]).pack()) for g in (5, 0, 3, 2)}
    joined, inside = PerfectHash.join(parts, 7), np.isin(bucket, list(parts))
    assert sorted(joined.number(keys[inside])) == list(range(int(inside.sum())))
    assert (joined.number(keys[~inside]) == -1).all()


def test_segments_are_those_of_whole_texts():
    aligner = Aligner(ALIGNED)
    assert aligner.cuts
    texts = [t for *_, t in ((r[0], r[1]) for r in documents(60))] + ODD + ["a  b", "a b  c \n d", "x \xa0 y\xa0z \xa0\xa0 w", "a\x1c b \x1fc", "  lead", "trail  "]
    numbers, counts = aligner.segments(texts)
    whole = Aligner(ALIGNED)
    whole.cuts = False
    alone, one = whole.segments(texts)
    assert counts.max() > 1 == one.max()
    assert [sums(c, counts).tolist() for c in aligner.numbers[numbers, :4].T] == [sums(c, one).tolist() for c in whole.numbers[alone, :4].T]
    parts = np.split(numbers, np.cumsum(counts)[:-1])
    lone = np.split(alone, np.cumsum(one)[:-1])
    assert [";".join(aligner.groups[i] for i in p) for p in parts] == [";".join(whole.groups[i] for i in p) for p in lone]
