"""The exact tree against one that tries every cut row by row, with nodes cut by Spark and inside tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.operators.exact_tree import ExactTree, grown
from rulewright.sources.scratch import temporary_tables


def plain(x, y, w, depth=0):
    """(depth, leaf function) by plain recursion over rows; ties to the first feature and smallest value."""
    if len(set(y)) < 2 or len(np.unique(x, axis=0)) < 2:
        one, zero = (w[k] * (y == k).sum() for k in (1, 0))
        return depth, lambda row: one / (one + zero)
    best = None
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for v, after in zip(values, values[1:]):
            sides = [[w[k] * int(((y == k) & side).sum()) for k in (0, 1)] for side in (x[:, j] <= v, x[:, j] > v)]
            score = sum((a * a + b * b) / (a + b) for a, b in sides)
            if best is None or score > best[0]:
                best = score, j, v, v + (after - v) / 2
    _, j, v, limit = best
    below = x[:, j] <= v
    (d1, left), (d2, right) = plain(x[below], y[below], w, depth + 1), plain(x[~below], y[~below], w, depth + 1)
    return max(d1, d2), lambda row: left(row) if row[j] <= limit else right(row)


def table(spark, x, y, w=(1.0, 1.0)):
    rows = [(i, [float(v) for v in a], int(b), w[int(b)]) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "i int, features array<double>, label int, w double")


def scores(fitted, df):
    return [r[0] for r in fitted.transform(df).orderBy("i").select("probability_1").collect()]


@pytest.mark.parametrize("task_rows", [1000, 40])
def test_equal_to_a_plain_tree(spark, task_rows):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 12, (260, 3)) / 4
    y = ((x[:, 0] > 1) ^ (x[:, 1] > x[:, 2]) ^ (rng.random(260) < 0.1)).astype(int)
    x[200:], y[200:] = x[0], np.arange(60) % 2  # copies of one row with both labels
    _, want = plain(x, y, (1.0, 2.5))
    new = np.concatenate([x, rng.random((50, 3)) * 3])
    with temporary_tables():
        fitted = ExactTree(task_rows=task_rows, weight_col="w").fit(table(spark, x, y, (1.0, 2.5)))
        assert bool(fitted.cuts) == (task_rows < 260)
        assert scores(fitted, table(spark, new, np.zeros(len(new)))) == pytest.approx([want(r) for r in new], abs=1e-12)


def test_deeper_than_thirty():
    """Each cut takes off an end, where labels alternate."""
    x, y = np.arange(120.0)[:, None], np.arange(120) % 2
    tree = grown(x, np.stack([1 - y, y], axis=1), (1.0, 1.0))
    depth = {0: 0}
    for i, (left, right) in enumerate(zip(tree["left"], tree["right"], strict=True)):
        if left >= 0:
            depth[left] = depth[right] = depth[i] + 1
    assert max(depth.values()) == plain(x, y, (1.0, 1.0))[0] > 30


def test_edges(spark):
    """One class, equal rows, missing values, a hot row that is scored in parts, no rows, unlike weights."""
    from rulewright.operators import exact_tree

    with temporary_tables():
        x = np.arange(30.0)[:, None]
        assert scores(ExactTree(task_rows=4).fit(table(spark, x, np.ones(30))), table(spark, x, np.ones(30))) == [1.0] * 30
        same = table(spark, np.ones((10, 2)), np.arange(10) % 2)
        assert scores(ExactTree(task_rows=4).fit(same), same) == [0.5] * 10 and ExactTree().fit(same).transform(same).where("prediction = 1").count() == 0
        odd = spark.createDataFrame([(0, [None, 1.0], 0), (1, [float("nan"), 5.0], 1), (2, [0.0, 5.0], 1), (3, [0.0, 0.0], None)], "i int, features array<double>, label int")
        assert scores(ExactTree().fit(odd), odd) == [0.0, 1.0, 1.0, 0.0]
        fitted = ExactTree(task_rows=8).fit(table(spark, x, (x[:, 0] // 3 % 2)))
        before, exact_tree.MET_ROWS = exact_tree.MET_ROWS, 7
        try:
            got = fitted.transform(table(spark, np.zeros((40, 1)), np.zeros(40)).withColumn("node", F.lit("clash")))
            assert got.where("prediction = 0 AND node = 'clash'").count() == 40
        finally:
            exact_tree.MET_ROWS = before
        empty = same.where("label > 1")
        assert fitted.transform(empty).count() == 0
        with pytest.raises(ValueError, match="no rows"):
            ExactTree().fit(empty)
        with pytest.raises(ValueError, match="differ in weight"):
            ExactTree(weight_col="i").fit(same)


def test_a_task_grows_all_nodes_of_a_level_together(spark):
    """20,000 rows of noise, whose tree has thousands of nodes, in little time; and few features let a task take more rows, as end cuts make many levels."""
    import time

    rng = np.random.default_rng(3)
    x, y = np.stack([rng.random(20_000), rng.random(20_000), *(rng.random((10, 20_000)) < 0.2)], axis=1), (rng.random(20_000) < 0.33).astype(int)
    began = time.process_time()
    tree = grown(x, np.stack([1 - y, y], axis=1), (1.0, 1.3))
    assert time.process_time() - began < 3 and len(tree["feature"]) > 8000
    at = np.zeros(len(x), int)
    while (inner := tree["feature"][at] >= 0).any():
        at[inner] = np.where(x[inner, tree["feature"][at[inner]]] <= tree["threshold"][at[inner]], tree["left"][at[inner]], tree["right"][at[inner]])
    assert np.array_equal(tree["share"][at], y)
    rows = spark.range(60_000).select(F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double")).alias("features"), (F.xxhash64("id") % 3 == 0).cast("int").alias("label"))
    with temporary_tables():
        fitted = ExactTree().fit(rows)
        assert not fitted.cuts and fitted.transform(rows).where("prediction <> label").count() == 0


def test_a_task_takes_a_million_rows_and_more(spark):
    """1,050,000 different rows of twelve features, ten of them 0 and 1: no level is Spark's."""
    id_ = F.col("id")
    rows = spark.range(1_050_000).select(F.array(id_.cast("double"), (id_ % 1000).cast("double"), *[(id_ % 10 == k).cast("double") for k in range(10)]).alias("features"), ((id_ > 700_000) != (id_ % 10 == 3)).cast("int").alias("label"))
    with temporary_tables():
        fitted = ExactTree().fit(rows)
        assert not fitted.cuts and fitted.transform(rows).where("prediction <> label").count() == 0


@pytest.mark.parametrize("at_once", [5, 1 << 15])
def test_one_hot_columns_and_cuts_in_parts(monkeypatch, at_once):
    """Features of 0 and 1 that share a column, that meet, and that lie between others; scores as the plain tree's."""
    from rulewright.operators import exact_tree

    monkeypatch.setattr(exact_tree, "CUTS_AT_ONCE", at_once)
    rng = np.random.default_rng(11)
    hot, other = np.eye(4)[rng.integers(0, 4, 150)], np.eye(3)[rng.integers(0, 3, 150)]
    x = np.concatenate([hot, rng.integers(0, 9, (150, 1)) / 2, other[:, :2], rng.random((150, 2)) < 0.4, np.ones((150, 1)), rng.integers(0, 3, (150, 1))], axis=1)
    y = (x[:, 2] + x[:, 4] * x[:, 6] + rng.random(150) > 1.2).astype(int)
    rows, at = np.unique(x, axis=0, return_inverse=True)
    counts = np.stack([np.bincount(at.reshape(-1), y == k, len(rows)) for k in (0, 1)], axis=1).astype(np.int64)
    tree = grown(rows, counts, (1.0, 1.5))
    depth, want = plain(x, y, (1.0, 1.5))
    new = np.concatenate([x, rng.permuted(x, axis=0)])
    node = np.zeros(len(new), int)
    while (inner := tree["feature"][node] >= 0).any():
        node[inner] = np.where(new[inner, tree["feature"][node[inner]]] <= tree["threshold"][node[inner]], tree["left"][node[inner]], tree["right"][node[inner]])
    assert tree["share"][node].tolist() == pytest.approx([want(r) for r in new], abs=1e-12)
