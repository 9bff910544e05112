"""The learning of operator 3 against an independent expectation-maximisation in plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from worthrank.llm.quality import DEFECTS, PRIOR_DOCS, START, START_DEFECT, START_SHARE, judge, learn_accuracies, posterior, votes

from .fixtures import documents, spark_documents, text

RULES = ("a", "b", "c", "d")
PRIORS = (START_DEFECT, START, START, START)  # rule a never votes good
TRUE_RATES = {"a": ((0.02, 0.0), (0.6, 0.0)), "b": ((0.1, 0.7), (0.5, 0.2)), "c": ((0.05, 0.5), (0.3, 0.1)), "d": ((0.3, 0.1), (0.1, 0.1))}


def _votes(n: int, seed: int = 5) -> list[tuple]:
    """(good, votes of the four rules); rule d votes bad more often on good documents."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        good = rng.random() < 0.7
        votes = []
        for rule in RULES:
            bad_rate, good_rate = TRUE_RATES[rule][0 if good else 1]
            x = rng.random()
            votes.append(-1 if x < bad_rate else 1 if x < bad_rate + good_rate else 0)
        rows.append((good, *votes))
    return rows


def _objective(patterns: Counter, share: float, rates: list) -> float:
    """Log of likelihood times prior; rates holds (fires, praise) by rule for good and for bad documents."""
    def prob(rule: int, cls: int, vote: int) -> float:
        fires, praise = rates[rule][cls]
        return fires if vote == -1 else (1 - fires) * (praise if vote == 1 else 1 - praise)

    total = PRIOR_DOCS * (START_SHARE * math.log(share) + (1 - START_SHARE) * math.log(1 - share))
    for rule in range(len(rates)):
        for cls, name in enumerate(("good", "bad")):
            total += PRIOR_DOCS * sum(x * math.log(prob(rule, cls, v)) for v, x in PRIORS[rule][name].items() if x)
    for votes, n in patterns.items():
        both = [w * math.prod(prob(r, c, v) for r, v in enumerate(votes)) for c, w in enumerate((share, 1 - share))]
        total += n * math.log(sum(both))
    return total


def _plain_em(rows: list[tuple], rounds: int) -> tuple[float, list]:
    """A document at a time, rates as pairs."""
    share = START_SHARE
    rates = [[(own[c][-1], own[c][1] / (1 - own[c][-1])) for c in ("good", "bad")] for own in PRIORS]
    for _ in range(rounds):
        mass = [PRIOR_DOCS * START_SHARE, PRIOR_DOCS * (1 - START_SHARE)]
        count = [[{v: PRIOR_DOCS * own[c][v] for v in (-1, 0, 1)} for c in ("good", "bad")] for own in PRIORS]
        for votes in rows:
            like = [share, 1 - share]
            for r, v in enumerate(votes):
                for c in (0, 1):
                    fires, praise = rates[r][c]
                    like[c] *= fires if v < 0 else (1 - fires) * praise if v > 0 else (1 - fires) * (1 - praise)
            p = like[0] / sum(like)
            for c, w in ((0, p), (1, 1 - p)):
                mass[c] += w
                for r, v in enumerate(votes):
                    count[r][c][v] += w
        share = mass[0] / sum(mass)
        for r in range(len(RULES)):
            of = [sum(count[r][c].values()) for c in (0, 1)]
            fires = [count[r][c][-1] / of[c] for c in (0, 1)]
            if fires[0] > fires[1]:
                fires = [(count[r][0][-1] + count[r][1][-1]) / sum(of)] * 2
            spoke = [count[r][c][0] + count[r][c][1] for c in (0, 1)]
            praise = [count[r][c][1] / spoke[c] for c in (0, 1)]
            if praise[0] < praise[1]:
                praise = [(count[r][0][1] + count[r][1][1]) / sum(spoke)] * 2
            rates[r] = list(zip(fires, praise, strict=True))
    return share, rates


def _rates(accuracy: dict) -> list:
    return [[(own[c][-1], own[c][1] / (1 - own[c][-1])) for c in ("good", "bad")] for own in accuracy.values()]


def test_learning_agrees_with_plain_em(spark):
    rows = _votes(1500)
    voted = spark.createDataFrame([r[1:] for r in rows], "a int, b int, c int, d int").repartition(5)
    for rounds in (1, 6):
        learned = learn_accuracies(voted, RULES, ("a",), rounds=rounds, tolerance=0.0)
        share, rates = _plain_em([r[1:] for r in rows], rounds)
        assert (learned.rounds, learned.converged) == (rounds, False)
        assert learned.share == pytest.approx(share, abs=1e-9)
        for found, expected in zip(_rates(learned.accuracy), rates, strict=True):
            assert [x for pair in found for x in pair] == pytest.approx([x for pair in expected for x in pair], abs=1e-9)


def test_objective_rises_to_an_optimum(spark):
    rows = _votes(1500)
    voted = spark.createDataFrame([r[1:] for r in rows], "a int, b int, c int, d int")
    learned = learn_accuracies(voted, RULES, ("a",), rounds=1000, tolerance=1e-7)
    assert learned.converged and learned.rounds == len(learned.objective) < 1000
    assert all(later >= earlier - 1e-7 for earlier, later in zip(learned.objective, learned.objective[1:], strict=False))
    patterns, rates = Counter(r[1:] for r in rows), _rates(learned.accuracy)
    best = _objective(patterns, learned.share, rates)
    assert best == pytest.approx(learned.objective[-1], abs=1e-4)
    for step in (-0.01, 0.01):  # no allowed step from there is better
        assert _objective(patterns, learned.share + step, rates) < best
        for rule in range(len(RULES)):
            for cls in (0, 1):
                for which in (0, 1):
                    moved = [[list(pair) for pair in own] for own in rates]
                    moved[rule][cls][which] += step
                    (fires_good, praise_good), (fires_bad, praise_bad) = moved[rule]
                    if 0 < moved[rule][cls][which] < 1 and fires_good <= fires_bad and praise_good >= praise_bad:
                        assert _objective(patterns, learned.share, moved) < best
    for own in learned.accuracy.values():
        assert own["good"][-1] <= own["bad"][-1] and sum(own["good"].values()) == pytest.approx(1)
    judged = (spark.createDataFrame(rows, "good boolean, a int, b int, c int, d int")
              .withColumn("p", posterior(learned.share, learned.accuracy)).collect())
    assert sum((r["p"] >= 0.5) == r["good"] for r in judged) > 0.85 * len(judged)


def test_defect_rules_never_vote_good(spark):
    most = judge(spark_documents(spark)).agg(*[F.max(f"vote_{r}").alias(r) for r in votes()]).first()
    assert {r for r in votes() if most[r] <= 0} == set(DEFECTS)


def test_learning_from_no_votes(spark):
    learned = learn_accuracies(spark.createDataFrame([], "a int, b int"), ("a", "b"))
    assert learned == (START_SHARE, {"a": START, "b": START}, 0, True, [])


def test_one_very_long_text_and_reruns(spark):
    rng = random.Random(8)
    rows = [*documents(30), (900, text(rng, "en", 6_000, 14), "en", "s", 0), (901, "word " * 60_000, "en", "s", 0)]
    docs = spark_documents(spark, rows)
    first, again = (sorted((r["doc_id"], r["n_words"], r["kept"], r["quality"]) for r in judge(x).collect()) for x in (docs, docs.repartition(7)))
    assert first == again
    by_id = {r[0]: r for r in first}
    assert by_id[900][2] and by_id[901][1:3] == (60_000, False)
