import hashlib
import re

import numpy as np
import pytest
from tests.llm.fixtures import documents, spark_documents

from worthrank.llm.exact_dedup import ENTRY, dedup_exact, merge_runs, normalise


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    """(doc_id, keep_id, group_size, sha) of each row and, per group, how many rows stay."""
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append(i)
    out = []
    for i, t in rows:
        own = groups[plain(t)]
        ids = [x for x in own if x is not None]
        out.append((i, min(ids) if ids else None, len(own), hashlib.sha256(plain(t).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a\t\n b ", "\x0b\x0c\r", "a  b c", "é\x1c\x85 x", "  x  y\n\n"])
def test_normalise_is_the_regular_expression(text):
    assert normalise(text).decode() == plain(text)


def test_merge_keeps_entries_with_another_digest_or_length_apart():
    rows = np.zeros(6, ENTRY)
    rows["d0"], rows["n"] = 7, 1
    rows["d3"] = [1, 1, 2, 1, 2, 1]
    rows["bytes"] = [5, 5, 5, 6, 5, 5]
    rows["no_id"], rows["id"], rows["row"] = [1, 0, 0, 0, 0, 0], [0, 9, 4, 1, 3, 9], [0, 1, 2, 3, 4, 0]
    got = merge_runs([rows[:2], rows[2:5], rows[5:]])
    assert [tuple(int(x[c]) for c in ("d3", "bytes", "id", "row", "n")) for x in got] == [(1, 5, 9, 0, 3), (1, 6, 1, 3, 1), (2, 5, 3, 4, 2)]


def test_dedup_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in documents(80)]
    rows += [(500 + i, "hot  copy" if i % 2 else "hot\ncopy") for i in range(120)]  # a third of all rows
    rows += [(700, "same row"), (700, "same row"), (None, "same row"), (None, "no id"), (None, "no id"), (3, "same id, other text"), (9, "x" * 2_000_000), (12, "x" * 2_000_000)]
    docs = spark.createDataFrame([(t, 1, i, "k", 0) for i, t in rows], "text string, run int, doc_id long, digest string, kept int").repartition(7)
    for parameters in ({}, {"range_rows": 4, "run_rows": 16}, {"range_rows": 2, "round_bits": 3, "run_rows": 5}):
        got = dedup_exact(docs, **parameters).collect()
        assert order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == order(brute(rows))
        kept = [r for r in got if r.kept]
        assert len(kept) == len({plain(t) for _, t in rows}) == len({r.text_sha256 for r in kept})
        assert all(r.doc_id == r.keep_id for r in kept)


def test_empty_table(spark):
    assert dedup_exact(spark_documents(spark, [])).count() == 0
