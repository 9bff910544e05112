import json
import os

import numpy as np
import pytest

from worthrank.operators import training
from worthrank.operators.training import Candidate, fit_heads, load_state, scan, state_frame, train_in_stages, training_rows
from worthrank.sinks.model_store import ModelStore


def frame(spark, n=60, width=5, seed=1, parts=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    y = (x @ rng.normal(size=width) + rng.normal(size=n) > 0).astype(int)
    rows = [(x[i].tolist(), int(y[i]), float(rng.uniform(0.5, 2)), "val" if i % 5 == 0 else "train") for i in range(n)]
    return spark.createDataFrame(rows, "v array<double>, label int, weight double, split string").repartition(parts), rows


def loss_of(rows, w):
    total = weight = 0.0
    for v, y, wt, split in rows:
        if split == "train":
            z = float(np.dot([*v, 1.0], w))
            total += wt * (np.log(1 + np.exp(-abs(z))) + max(z, 0) - z * y)
            weight += wt
    return total / weight


def test_gradient_is_the_slope_of_the_loss(spark, monkeypatch):
    df, rows = frame(spark)
    held = training_rows(df, "v", weight_col="weight", split_col="split")
    w = np.random.default_rng(2).normal(size=(3, 6))
    for fan_in in (64, 2):  # at once, and up a tree
        monkeypatch.setattr(training, "FAN_IN", fan_in)
        got = scan(held, w)
        for c in range(3):
            assert got.loss[c] == pytest.approx(loss_of(rows, w[c]), rel=1e-12)
            for d in range(6):
                up, down = w[c].copy(), w[c].copy()
                up[d] += 1e-5
                down[d] -= 1e-5
                assert got.gradient[c, d] == pytest.approx((loss_of(rows, up) - loss_of(rows, down)) / 2e-5, abs=1e-8)
            right = [(np.dot([*v, 1.0], w[c]) > 0) == (y == 1) for v, y, _, split in rows if split == "val"]
            assert (got.val_rows, got.val_right[c]) == (len(right), sum(right))
    held.unpersist()


def test_candidates_fitted_together_are_those_fitted_alone(spark):
    df, rows = frame(spark, parts=3)
    held = training_rows(df, "v", weight_col="weight", split_col="split")
    candidates = [Candidate(0.5), Candidate(1.0, 0.3), Candidate(0.5)]
    together = fit_heads(held, candidates, 4)
    for c, candidate in enumerate(candidates):
        alone = fit_heads(held, [candidate], 4)
        assert np.allclose([w[c] for w in together.weights], [w[0] for w in alone.weights], atol=1e-13)
    losses = [t[2] for t in together.trace if t[1] == 0]
    assert losses == sorted(losses, reverse=True)
    best = together.best()
    accs = {(s, c): a for s, c, _, a, _ in together.trace}
    assert accs[best] == max(accs.values()) and best == min(k for k, a in accs.items() if a == accs[best])
    held.unpersist()


def test_one_scan_a_step_whatever_the_number_of_candidates(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(training, "scan", lambda rows, w: calls.append(len(w)) or scan(rows, w))
    held = training_rows(frame(spark)[0], "v", split_col="split")
    fit_heads(held, [Candidate(0.1 * i) for i in range(1, 8)], 3)
    held.unpersist()
    assert calls == [7] * 4


def test_stages_go_on_from_saved_weights(spark, tmp_path):
    df, rows = frame(spark)
    train = df.where("split = 'train'")
    whole = train_in_stages(spark, [("only", train)], Candidate(0.7, 0.1), 6, str(tmp_path / "a"), "v", weight_col="weight")
    halves = train_in_stages(spark, [("one", train), ("two", train)], Candidate(0.7, 0.1), 3, str(tmp_path / "b"), "v", weight_col="weight")
    assert np.allclose(whole["only"].weights[-1], halves["two"].weights[-1], atol=1e-12)
    assert (halves["two"].weights[0] == load_state(spark, str(tmp_path / "b" / "one"))).all()
    with pytest.raises(ValueError, match="features"):
        held = training_rows(df, "v")
        fit_heads(held, [Candidate(1.0)], 1, start=np.zeros(4))


def test_unsound_rows_take_no_part(spark):
    good = [([1.0, 2.0], 1, 1.0), ([0.5, -1.0], 0, 1.0), ([2.0, 0.0], None, 2.0)]
    bad = [(None, 1, 1.0), ([1.0, None], 1, 1.0), ([float("nan"), 0.0], 1, 1.0), ([float("inf"), 0.0], 0, 1.0), ([1.0], 1, 1.0), ([1.0, 2.0], 1, None), ([9.0, 9.0], 1, 0.0)]
    fits = []
    for rows in (good, good + bad):
        held = training_rows(spark.createDataFrame(rows, "v array<double>, label int, weight double"), "v", weight_col="weight")
        assert held.count() == len(good)
        fits.append(fit_heads(held, [Candidate(1.0)], 2))
        held.unpersist()
    assert np.allclose(fits[0].weights[-1], fits[1].weights[-1], atol=1e-14)
    assert fits[0].best() == (2, 0)
    empty = training_rows(spark.createDataFrame([], "v array<double>, label int, weight double"), "v", weight_col="weight")
    assert fit_heads(empty, [Candidate(1.0)], 2).weights[-1].tolist() == [[0.0]]


def test_state_round_trip(spark, tmp_path):
    held = training_rows(frame(spark)[0], "v", split_col="split")
    fit = fit_heads(held, [Candidate(1.0), Candidate(0.1)], 2)
    held.unpersist()
    state_frame(spark, fit, 1).write.parquet(str(tmp_path / "s"))
    assert (load_state(spark, str(tmp_path / "s")) == fit.weights[1]).all()


def writer(path, text, calls):
    def write(p):
        calls.append(p)
        os.makedirs(p, exist_ok=True)
        with open(f"{p}/model", "w") as f:
            f.write(text)
    return write


def test_only_better_models_are_committed(spark, tmp_path):
    store, calls = ModelStore(spark, str(tmp_path)), []
    assert store.current() is None and store.current_path() is None
    assert store.offer("a", 0.5, writer(tmp_path, "a", calls))
    for worse in (0.4, 0.5, float("nan")):
        assert not store.offer("b", worse, writer(tmp_path, "b", calls))
    assert store.current() == {"version": "a", "metric": 0.5} and len(calls) == 1
    assert store.offer("a", 0.5, writer(tmp_path, "again", calls))  # a retry of what has been committed writes nothing
    assert store.offer("c", 0.7, writer(tmp_path, "c", calls))
    assert store.offer("a", 0.9, writer(tmp_path, "late", calls)) and store.current()["version"] == "c"
    assert open(f"{tmp_path}/versions/a/model").read() == "a"
    assert ModelStore(spark, str(tmp_path) + "/").current_path() == f"{tmp_path}/versions/c"


def test_a_failed_write_and_a_cut_off_record_leave_the_model_as_it_was(spark, tmp_path):
    store, calls = ModelStore(spark, str(tmp_path)), []
    store.offer("a", 0.5, writer(tmp_path, "a", calls))

    def fails(path):
        writer(tmp_path, "half", calls)(path)
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        store.offer("b", 0.6, fails)
    assert store.current()["version"] == "a"
    open(tmp_path / "commits" / "0000000001.json", "w").close()  # a driver that died while it wrote its record
    assert store.current()["version"] == "a"
    assert store.offer("b", 0.6, writer(tmp_path, "b", calls)) and store.current()["version"] == "b"
    assert open(f"{tmp_path}/versions/b/model").read() == "b"


def test_a_second_writer_that_was_first_wins_if_it_is_better(spark, tmp_path):
    store, calls = ModelStore(spark, str(tmp_path)), []
    for own, other, wins in ((0.5, 0.6, False), (0.9, 0.7, True)):
        def overtaken(path, other=other):
            writer(tmp_path, "own", calls)(path)
            os.makedirs(tmp_path / "commits", exist_ok=True)
            taken = [int(x[:10]) for x in os.listdir(tmp_path / "commits") if x.endswith(".json") and not x.startswith(".")]
            with open(tmp_path / "commits" / f"{max(taken, default=-1) + 1:010d}.json", "w") as f:
                json.dump({"version": f"other-{other}", "metric": other}, f)
        assert store.offer(f"own-{own}", own, overtaken) is wins
        assert store.current()["metric"] == max(own, other)
