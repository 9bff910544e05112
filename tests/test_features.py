"""The exact feature index, texts as indexed vectors, the split join and document sequences."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from worthrank.operators import blocks, training
from worthrank.operators.encode import build_vocabulary, encode, split_join
from worthrank.operators.features import feature_index, indexed_texts, ngram_terms
from worthrank.operators.sequences import document_sequences
from worthrank.operators.training import Candidate, fit_heads, indexed_rows, scan, training_rows

TEXTS = ["The cat sat. The cat!", "a cat", "", None, "the the the", "Éa 12 b_c", "dog"]


def terms(text, n=2):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return words + [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def texts(spark, rows=TEXTS):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


@pytest.mark.parametrize("n", [1, 2, 3])
def test_terms(spark, n):
    got = {r.id: r.t for r in texts(spark).select("id", ngram_terms("text", n).alias("t")).collect()}
    assert all(sorted(got[i] or []) == sorted(terms(t, n)) for i, t in enumerate(TEXTS))


def test_index_numbers_every_term_by_document_frequency(spark):
    df = Counter(t for x in TEXTS for t in set(terms(x)))
    expected = [(t, c, i + 1) for i, (t, c) in enumerate(sorted(df.items(), key=lambda x: (-x[1], x[0])))]
    assert [tuple(r) for r in feature_index(texts(spark), "id", "text").orderBy("feature").collect()] == expected
    assert [r.term for r in feature_index(texts(spark), "id", "text", min_docs=2).orderBy("feature").collect()] == [t for t, c, _ in expected if c > 1]


def test_indexed_texts_hold_tf_idf_and_fit_as_dense_rows_do(spark):
    index = feature_index(texts(spark), "id", "text")
    place = {r.term: (r.feature - 1, r.docs) for r in index.collect()}
    frame = texts(spark, [*TEXTS, "unknown words"]).withColumn("label", (F.col("id") % 2).cast("int")).withColumn("split", F.when(F.col("id") == 4, "val").otherwise("train"))
    got = indexed_texts(frame, "id", "text", index, len(TEXTS))
    width = len(place)
    dense = {}
    for r in got.collect():
        own = Counter(t for t in terms([*TEXTS, "unknown words"][r.id]) if t in place)
        expected = sorted((place[t][0], n * math.log((len(TEXTS) + 1) / (place[t][1] + 1))) for t, n in own.items())
        assert list(r["index"]) == [f for f, _ in expected] and r.features == pytest.approx([v for _, v in expected])
        dense[r.id] = np.zeros(width)
        dense[r.id][list(r["index"])] = r.features
    held = indexed_rows(got, split_col="split")
    as_dense = training_rows(spark.createDataFrame([(dense[i].tolist(), i % 2, "val" if i == 4 else "train") for i in dense], "v array<double>, label int, split string"), "v", split_col="split")
    w = np.random.default_rng(0).normal(size=(2, width + 1))
    a, b = scan(held, w), scan(as_dense, w)
    assert np.allclose(a.gradient, b.gradient) and np.allclose(a.loss, b.loss) and (a.val_rows, list(a.val_right)) == (b.val_rows, list(b.val_right))
    fit = fit_heads(held, [Candidate(0.3, 0.5)], 60, width=width, tolerance=0.01)
    assert fit.converged and 3 < len(fit.weights) <= 60 and fit.trace[-1][4] > 0.01
    assert all(x[4] >= y[4] for x, y in zip(fit.trace[5:], fit.trace[6:], strict=False))
    assert not fit_heads(held, [Candidate(0.3, 0.5)], 3, width=width, tolerance=0.01).converged
    held.unpersist()
    as_dense.unpersist()


@pytest.mark.parametrize("block", [4, 1 << 18])
def test_a_fit_in_blocks_takes_the_steps_of_one_that_holds_all_weights(spark, monkeypatch, block):
    """Weights and gradients of a fit over rows with ids never come to the driver: it gets sums over the rows only."""
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(blocks, "GROUP", 3)
    monkeypatch.setattr(blocks, "HELD_BYTES", 20)
    rng, width = np.random.default_rng(3), 37
    data = []
    for i in range(50):
        at = sorted(rng.choice(width, size=int(rng.integers(0, 9)), replace=False).tolist())
        data.append((i if i < 40 else None if i < 42 else 39, at, rng.normal(size=len(at)).tolist(), int(i % 3 == 0), "val" if i % 5 == 0 else "train", [1.0, 0.5, 0.0, None][i % 4]))
    df = spark.createDataFrame(data, "doc long, index array<long>, features array<double>, label int, split string, w double").repartition(3)
    candidates = [Candidate(0.3, 0.2), Candidate(1.0)]
    plain_rows = indexed_rows(df, weight_col="w", split_col="split")
    plain = fit_heads(plain_rows, candidates, 4, width=width)
    plain_rows.unpersist()
    with monkeypatch.context() as m:
        m.setattr(training, "scan", None)
        fit = fit_heads(indexed_rows(df, weight_col="w", split_col="split", id_col="doc"), candidates, 4, width=width)
    assert np.allclose(np.array(fit.trace, float), np.array(plain.trace, float), atol=1e-12) and fit.best() == plain.best()
    for one, other in zip(fit.weights, plain.weights, strict=True):
        w = np.zeros((2, width + 1))
        w[:, -1] = one.constant
        for r in one.frame().collect():
            w[r.candidate, r["index"]] = r.weight
        assert np.allclose(w, other, atol=1e-12)
    fit.close()
    with pytest.raises(ValueError, match="start from zeros"):
        fit_heads(indexed_rows(df, id_col="doc"), candidates, 1, start=np.zeros(width + 1), width=width)


def test_a_fit_in_blocks_without_rows_or_features(spark):
    schema = "doc long, index array<long>, features array<double>, label int"
    for rows, width, losses in (([], 0, [math.nan] * 2), ([(1, [], [], 1), (2, [], [], 0)], 0, [math.log(2)] * 2), ([(1, [], [], 1)], 3, [math.log(2), math.log(1 + math.exp(-0.5))])):
        fit = fit_heads(indexed_rows(spark.createDataFrame(rows, schema), id_col="doc"), [Candidate(1.0)], 2, width=width)
        held = [x[2] for x in fit.trace]
        assert np.allclose(held, losses[: len(held)], equal_nan=True) and len(fit.weights) == len(held) + 1
        assert all(w.frame().count() == 0 for w in fit.weights)
        fit.close()


def test_frequent_keys_are_not_shuffled(spark):
    n = 4000  # "the" on half of all positions
    rows = [(i, " ".join("the" if j % 2 else f"w{(i * 7 + j) % 97}" for j in range(20))) for i in range(n // 20)]
    df = spark.createDataFrame(rows, "id long, text string")
    vocab = build_vocabulary(df, "text").checkpoint()
    plain = {r.token: r.id for r in vocab.collect()}
    for heavy in (0, 1, 10, 1000):
        got = encode(df, ["id"], "text", vocab, heavy=heavy)
        assert {r.id: r.ids for r in got.collect()} == {i: [plain[t] for t in x.split()] for i, x in rows}
    exploded = df.select("id", F.explode(F.split("text", " ")).alias("token"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = split_join(exploded, vocab.withColumnRenamed("id", "rank"), "token", "rank", [], 1)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        # half of the tokens meet a broadcast; the others meet the rest of the vocabulary by shuffle
        assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1
        rest = exploded.join(F.broadcast(vocab.where("id <= 1").select("token")), "token", "left_anti").repartition(8, "token")
        sizes = [r["count"] for r in rest.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 3 * sum(sizes) / 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sequences_are_those_of_a_plain_walk(spark):
    rows = [(0, i, f"hot {i}") for i in range(300)] + [(d, i, None if i == 1 else f"{d} {i}") for d in range(1, 120) for i in range(d % 5 + 1)] + [(None, i, f"n{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, line long, text string").repartition(6)
    expected = []
    for d in {r[0] for r in rows}:
        own = sorted((i, t) for x, i, t in rows if x == d)
        expected += [(d, i, t, k + 1, len(own), own[k - 1][1] if k else None, own[k + 1][1] if k + 1 < len(own) else None) for k, (i, t) in enumerate(own)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for partitions in (None, 1, 9):
            got = document_sequences(df, "doc_id", ["line"], "text", partitions).collect()
            assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_equal_places_keep_neighbours_and_positions_together(spark):
    df = spark.createDataFrame([(1, 5, f"t{i}") for i in range(50)], "doc_id long, line long, text string").repartition(4)
    rows = sorted(document_sequences(df, "doc_id", ["line"], "text", 4).collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(1, 51))
    assert [r.previous for r in rows[1:]] == [r.text for r in rows[:-1]] and [r.next for r in rows[:-1]] == [r.text for r in rows[1:]]
