import math
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.fixtures import documents, spark_documents

from worthrank.llm.ball_tree import BallTree, Sparse, search
from worthrank.llm.lexical_search import Items, impacts, rank_documents, search_block, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    held = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    by_item = {}
    for i, t in items:
        by_item.setdefault(i, set()).update(words(t))
    out = []
    for item, own in by_item.items():
        scored = []
        for doc, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0 and doc is not None:
                scored.append((-s, doc))
        out += [(item, rank + 1, doc, -s) for rank, (s, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("text", [None, "", " ", "A-b_C", "Äé 中文 x1y2", "a\x00b\x7fc", "[\\]^`{|}~@", "ZZ zz Zz", "it's 3.14"])
def test_terms_are_those_of_the_pattern(text):
    assert [t.decode() for t in terms(text)] == words(text)


def test_ranking_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in documents(90)]
    rows += [(600 + i, "the same copy of text river stone") for i in range(70)] + [(None, "the river"), (601, "the river"), (601, "the river"), (1, "word " * 200_000)]
    items = [(0, rows[3][1]), (1, "the river"), (1, "stone"), (2, None), (3, ""), (4, "qqqqqq"), (5, "THE the The"), (None, "maison"), (7, rows[60][1]), (8, rows[11][1]), (8, rows[11][1])]
    docs = spark.createDataFrame([(t, "k", 3, i) for i, t in rows], "text string, term string, score int, doc_id long").repartition(3)
    table = spark.createDataFrame([(t, 1, i) for i, t in items], "text string, rank int, item_id long")
    for k, parameters in ((50, {}), (5, {"tree_rows": 16, "leaf": 2, "block_terms": 20}), (3, {"tree_entries": 40, "leaf": 1, "block": 7}), (50, {"tree_rows": 50, "block": 10_000})):
        assert got(rank_documents(docs, table, k, **parameters)) == brute(rows, items, k)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert rank_documents(spark_documents(spark, []), items).count() == 0
    assert rank_documents(spark_documents(spark), items.limit(0)).count() == 0
    assert rank_documents(spark.createDataFrame([(1, None), (2, "...")], "doc_id long, text string"), items).count() == 0


def random_block(rng, n_docs, n_items, width):
    starts, index, value = [0], [], []
    for _ in range(n_docs):
        own = np.sort(rng.choice(width, rng.integers(0, 12), replace=False, p=np.arange(width, 0, -1) / (width * (width + 1) / 2)))
        index.append(own)
        value.append(impacts(np.full(len(own), 40), rng.integers(1, 9, len(own)), 100, 4000))
        starts.append(starts[-1] + len(own))
    items = [np.sort(rng.choice(width, 6, replace=False)) for _ in range(n_items)]
    return Sparse(np.array(starts), np.concatenate(index), np.concatenate(value), width), np.arange(0, 6 * n_items + 1, 6), np.concatenate(items)


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_no_bound_is_below_a_score_and_pruning_loses_nothing(block):
    rng = np.random.default_rng(block)
    rows, starts, index = random_block(rng, 600, 40, 90)
    weights = rng.integers(1, 9000, 90)
    items = Items(starts, index, weights[index], 90, block)
    dense = np.zeros((len(rows), 90), np.int64)
    dense[np.repeat(np.arange(len(rows)), np.diff(rows.starts)), rows.index] = rows.value
    scores = np.stack([dense[:, index[s : s + 6]] @ weights[index[s : s + 6]] for s in starts[:-1]])
    tree = BallTree(Sparse(rows.starts, rows.index, rows.value * np.sqrt(weights)[rows.index], 90), 4, block, items.bounds)
    assert sorted(tree.order.tolist()) == list(range(len(rows)))
    for i, kept in enumerate(tree.kept):
        assert (kept >= scores[:, tree.order[tree.first[i] : tree.last[i]]].max(axis=1)).all()
    best, done = search_block(iter([(np.arange(len(rows)), rows)]), items, weights, 10, 4, block)
    for own, b in zip(scores, best, strict=True):
        expected = sorted((-s, d) for d, s in enumerate(own.tolist()) if s > 0)[:10]
        assert list(zip((-b.scores).tolist(), b.ids.tolist(), strict=True)) == expected
    assert done["documents"] == 600
    if block == 1:  # by coordinate most of the work is saved
        assert done["scored"] < 0.5 * 600 * 40


def test_leaves_are_met_by_falling_bounds():
    rng = np.random.default_rng(5)
    rows, starts, index = random_block(rng, 200, 1, 40)
    weights = np.full(40, 100)
    items = Items(starts, index, weights[index], 40, 1)
    tree = BallTree(Sparse(rows.starts, rows.index, rows.value * 10.0, 40), 8, 1, items.bounds)
    bounds = np.stack(tree.kept, axis=1)[0]
    met = []
    assert search(tree, bounds, lambda: 0.0, lambda a, b: met.append((a, b))) == len(met)
    assert sorted(met)[0][0] == 0 and sum(b - a for a, b in met) == 200
