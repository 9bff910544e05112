"""The counterfactual objective against slopes and an optimum found another way, and what it does to group names."""

import random

import numpy as np
import pytest
from tests.llm.fixtures import spark_documents

from worthrank.llm.toxicity import IDENTITY_SETS, Objective, fit


def objective(pair_weight=0.7, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.random() < 0.4), sorted(rng.choice(6, rng.integers(0, 5), replace=False).tolist())) for _ in range(40)]
    pairs = [([0, 1], [2], 3.0), ([3], [], 1.0), ([], [4, 5], 10.0)]
    return rows, pairs, Objective(rows, pairs, 6, {0: 2.0, 1: 1.0}, pair_weight, 0.5)


def plain_loss(rows, pairs, w, b, pair_weight):
    weights = [2.0 if y == 0 else 1.0 for y, _ in rows]
    total = 0.0
    for (y, has), q in zip(rows, weights, strict=True):
        z = sum(w[i] for i in has) + b
        total += q * len(rows) / sum(weights) * (np.log(1 + np.exp(z)) - y * z)
    total += 0.5 * sum(x * x for x in w) / 2
    return total + pair_weight * sum(n * (sum(w[i] for i in lost) - sum(w[i] for i in gained)) ** 2 for lost, gained, n in pairs)


def test_value_and_slopes():
    rows, pairs, o = objective()
    w, b = np.random.default_rng(1).normal(size=6), 0.3
    value, slopes, slope_b = o.loss(w, b)
    assert value == pytest.approx(plain_loss(rows, pairs, w, b, 0.7), rel=1e-12)
    for d in range(6):
        up, down = w.copy(), w.copy()
        up[d] += 1e-5
        down[d] -= 1e-5
        assert slopes[d] == pytest.approx((plain_loss(rows, pairs, up, b, 0.7) - plain_loss(rows, pairs, down, b, 0.7)) / 2e-5, abs=1e-6)
    assert slope_b == pytest.approx((plain_loss(rows, pairs, w, b + 1e-5, 0.7) - plain_loss(rows, pairs, w, b - 1e-5, 0.7)) / 2e-5, abs=1e-6)


@pytest.mark.parametrize("pair_weight", [0.0, 0.7, 20.0])
def test_descent_reaches_the_optimum_of_newton_steps(pair_weight):
    _, _, o = objective(pair_weight)
    found, bias = o.descend(3000)
    x = np.zeros(7)
    for _ in range(60):  # Newton's method with slopes of slopes by differences
        slope = lambda v: np.append(o.loss(v[:6], v[6])[1], o.loss(v[:6], v[6])[2])
        curve = np.stack([(slope(x + 1e-5 * e) - slope(x - 1e-5 * e)) / 2e-5 for e in np.eye(7)])
        x -= np.linalg.solve(curve, slope(x))
    assert np.allclose(np.append(found, bias), x, atol=1e-4)


def test_order_of_rows_and_pairs_is_nothing():
    rows, pairs, o = objective()
    other = Objective(rows[::-1], pairs[::-1], 6, {0: 2.0, 1: 1.0}, 0.7, 0.5)
    assert (o.descend(50)[0] == other.descend(50)[0]).all()


def biased_rows(n=400):
    """Insults go along with women and, less often, with muslims."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 2
        who = rng.choice(("women", "women", "women", "muslims", "men") if toxic else ("men", "men", "men", "christians", "women"))
        said = rng.choice(("scumbag", "vermin") if rng.random() < 0.8 else ("river",)) if toxic else rng.choice(("river", "house"))
        rows.append((i, f"The {who} of the {said} spoke. Stone and house.", "en", "s", 1))
        labels.append((i, toxic))
    return rows, labels


def test_names_of_groups_lose_their_weight(spark):
    rows, labels = biased_rows()
    docs, marked = spark_documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, fair = fit(docs, marked, pair_weight=0.0), fit(docs, marked)
    gap = lambda m, a, b: abs(m.scorer()(f"The {a} spoke") - m.scorer()(f"The {b} spoke"))
    assert gap(plain, "women", "men") > 0.2
    assert gap(fair, "women", "men") < 0.25 * gap(plain, "women", "men")
    for own in IDENTITY_SETS:  # whichever name it is swapped for
        for a in own:
            assert all(gap(fair, a, b) < 0.1 for b in own if b != a)
    assert fair.scorer()("The women of the scumbag spoke. Stone and house.") > 0.5 > fair.scorer()("The women of the house spoke. Stone and house.")


def test_mentions_all_count_wherever_they_are(spark):
    rows, labels = biased_rows()
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    a, b = (fit(spark_documents(spark, r).repartition(k), marked) for r, k in ((rows, 1), (rows[::-1], 5)))
    assert a.weights == b.weights and a.bias == b.bias
    many = [(i, t + " The girls saw the boys." * 3000, *x) if i == 7 else (i, t, *x) for i, t, *x in rows]
    assert len(fit(spark_documents(spark, many), marked, min_texts=1).weights) > 0
