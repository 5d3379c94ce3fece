"""The net's gradient against finite differences, its fit on Spark against a plain loop, and its ways to end."""

import numpy as np
import pytest

from rulewright.operators import net
from rulewright.operators.net import FittedNet, Net


def rows_of(n, seed=1, d=3):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, (x[:, 0] * x[:, 1] > 0).astype(float)


def table(spark, x, y):
    return spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)], "features array<double>, label double")


def test_gradient_by_finite_differences():
    sizes, (x, y) = (3, 5, 4, 1), rows_of(17)
    v = net.first_weights(sizes, 3)
    _, g = net.loss_and_gradient(v, sizes, x, y, 0.1)
    for i in range(len(v)):
        up, down = v.copy(), v.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (net.loss_and_gradient(up, sizes, x, y, 0.1)[0] - net.loss_and_gradient(down, sizes, x, y, 0.1)[0]) / 2e-6
        assert g[i] == pytest.approx(slope, abs=1e-6)


def test_one_block_is_plain_adam(spark, monkeypatch):
    """Same batches, another way to write the steps: moments with their corrections divided out."""
    x, y = rows_of(50)
    made = Net(hidden=(6,), passes=3, batch=16, held_out=0.0, l2=0.0)
    df = table(spark, x, y)
    got = made.fit(df)
    key = np.array([r[0] for r in table(spark, x, y).selectExpr("xxhash64(features, label)").collect()], np.int64)
    x, y = x[np.argsort(key)], y[np.argsort(key)]
    w, t = net.first_weights((3, 6, 1), 42), 0
    m = v = np.zeros(len(w))
    for i in range(3):
        order = np.random.default_rng([42, i, int(key.min()) % 2**63]).permutation(50)
        for a in range(0, 50, 16):
            g, t = net.loss_and_gradient(w, (3, 6, 1), x[order[a : a + 16]], y[order[a : a + 16]], 0.0)[1], t + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 1e-3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8 / np.sqrt(1 - 0.999**t))
    monkeypatch.setattr(net, "PASSES", 2)
    assert np.array_equal(made.fit(df).vector, got.vector)  # jobs of two passes and one
    assert got.passes == 3 and np.allclose(got.vector, w, atol=1e-9)


def test_blocks_are_averaged_by_rows(spark, monkeypatch):
    """One pass over several blocks is the average of the blocks' own passes; equal runs give equal weights."""
    x, y = rows_of(90)
    monkeypatch.setattr(net, "BLOCK_ROWS", 32)
    made = Net(hidden=(4,), passes=1, batch=8, held_out=0.0)
    got = made.fit(table(spark, x, y))
    assert got.passes == 1 and np.array_equal(got.vector, made.fit(table(spark, x, y)).vector)
    sizes = (3, 4, 1)
    start = np.concatenate([net.first_weights(sizes, 42), np.zeros(2 * net.n_weights(sizes))])
    frame = spark.createDataFrame([(b, n, 0, bytearray(xs.tobytes()), bytearray(ys.tobytes()), bytearray(np.zeros(n, bool).tobytes())) for b, n, xs, ys in ((0, 60, x[:60], y[:60]), (1, 30, x[60:], y[60:]))], net.BLOCK)
    ((told, state),) = made._passes(frame, 2, sizes, start, 0, range(1), False)
    own = [made._batches(a, b, sizes, start.copy(), 0, [42, 0, k])[2] for k, (a, b) in enumerate(((x[:60], y[:60]), (x[60:], y[60:])))]
    assert np.allclose(state, (own[0] * 60 + own[1] * 30) / 90) and told["rows"] == 90 and told["steps"] == 8


def test_it_learns_what_no_line_can_and_goes_on_from_weights(spark):
    x, y = rows_of(600)
    df = table(spark, x, y)
    first = Net(hidden=(32, 16), passes=60, batch=32, step=5e-3).fit(df)
    right = lambda fitted: np.mean([r[0] == r[1] for r in fitted.transform(df).select("label", "prediction").collect()])
    assert right(first) > 0.93
    again = Net(hidden=(32, 16), passes=1, batch=32, held_out=0.0).fit(df, start=first)
    assert again.passes == 1 and right(again) > 0.93 and np.abs(again.vector - first.vector).max() < 0.05


def test_ends(spark):
    """Labels of pure noise end long before the last pass; equal rows are fitted; no rows are an error."""
    x, _ = rows_of(120)
    noise = table(spark, x, (np.arange(120) % 2).astype(float))
    got = Net(hidden=(4,), passes=300, batch=32, step=1e-6).fit(noise)
    assert got.passes < 30
    flat = Net(hidden=(4,), passes=300, batch=32, step=1e-9, held_out=0.0).fit(noise)
    assert flat.passes < 30
    same = table(spark, np.ones((40, 2)), np.ones(40))
    assert Net(hidden=(4,), passes=40, batch=8, step=1e-2).fit(same).transform(same).where("prediction = 1").count() == 40
    with pytest.raises(ValueError, match="no rows"):
        Net().fit(noise.where("label > 1"))
    empty = noise.where("label > 1")
    assert FittedNet((3, 1), np.zeros(4), 1).transform(empty).count() == 0
