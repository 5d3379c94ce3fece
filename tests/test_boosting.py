"""Boosting on Spark against a plain booster that tries every cut of every value, on small tables."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.operators import boosting
from rulewright.operators.boosting import BoostedTrees, Boosting


def made(n, seed, levels=9):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, levels, (n, 4)) / 2
    y = ((x[:, 0] > 2) ^ (x[:, 1] * rng.random(n) > 1.5) | (x[:, 3] == 0)).astype(float)
    return x, y, 1 + (np.arange(n) % 3) / 2


def table(spark, x, y, w):
    rows = [(i, [float(v) for v in a], float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(rows, "i int, features array<double>, label double, w double")


def keys(df):
    return np.array([r[0] for r in df.orderBy("i").select(F.xxhash64("features", "label")).collect()], np.int64)


def plain_tree(s, x, g, h, columns, in_sample):
    """Nested dicts: the best cut of each node over all values; popped by gain for ``max_leaves``, else level by level."""
    def best(rows):
        found, g_all, h_all = None, g[rows].sum(), h[rows].sum()
        for j in columns:
            for v in np.unique(x[rows, j])[:-1]:
                left = rows[x[rows, j] <= v]
                right = rows[x[rows, j] > v]
                if min(h[left].sum(), h[right].sum()) < s.least_hessian or min(len(left), len(right)) < s.least_rows:
                    continue
                gain = g[left].sum() ** 2 / (h[left].sum() + s.l2) + g[right].sum() ** 2 / (h[right].sum() + s.l2) - g_all**2 / (h_all + s.l2)
                if found is None or gain > found[0] + 1e-9:
                    found = gain, j, v, left, right
        return found if found and found[0] > 1e-10 else None

    leaf = lambda rows, depth: {"rows": rows, "depth": depth, "value": -s.step * g[rows].sum() / (h[rows].sum() + s.l2)}
    root = leaf(np.nonzero(in_sample)[0], 0)
    heap, order, n_leaves = [], 0, 1

    def offer(node):
        nonlocal order
        if (s.max_depth is None or node["depth"] < s.max_depth) and (cut := best(node["rows"])):
            heapq.heappush(heap, (-cut[0], order, node, cut))
            order += 1

    offer(root)
    while heap and (s.max_leaves is None or n_leaves < s.max_leaves):
        _, _, node, (_, j, v, left, right) = heapq.heappop(heap)
        node |= {"j": j, "v": v, "left": leaf(left, node["depth"] + 1), "right": leaf(right, node["depth"] + 1)}
        n_leaves += 1
        offer(node["left"])
        offer(node["right"])
    return root


def plain_margin(tree, row):
    while "j" in tree:
        tree = tree["left" if row[tree["j"]] <= tree["v"] else "right"]
    return tree["value"]


def plain_fit(s, x, y, w, key, start=None):
    margin = np.zeros(len(x)) if start is None else np.array(start)
    for round_ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = plain_tree(s, x, w * (p - y), w * p * (1 - p), s.columns(round_, x.shape[1]), boosting.drawn_rows(key, round_, s.seed, s.row_share))
        margin = margin + [plain_margin(tree, row) for row in x]
    return margin


def margins(model, df):
    return [r["margin"] for r in model.transform(df).orderBy("i").collect()]


SETTINGS = [
    Boosting(rounds=6, step=0.3, max_depth=3, weight_col="w"),
    Boosting(rounds=5, step=0.5, max_leaves=6, row_share=1.0, column_share=1.0, l2=0.5, least_rows=3),
    Boosting(rounds=3, step=0.2, max_leaves=40, least_hessian=1e-3, column_share=0.5),
]


@pytest.mark.parametrize("s", SETTINGS)
def test_same_margins_as_the_plain_booster(spark, s, monkeypatch):
    """With several blocks, and margins written anew every second round."""
    monkeypatch.setattr(boosting, "SNAPSHOT", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 60)
    x, y, w = made(150, 1)
    df = table(spark, x, y, w)
    model = s.fit(df.repartition(3))
    assert len(model.trees) == s.rounds and (s.max_leaves is None or max(sum(f < 0 for f in t.feature) for t in model.trees) <= s.max_leaves)
    assert s.max_depth is None or max(t.depth() for t in model.trees) <= s.max_depth
    assert margins(model, df) == pytest.approx(list(plain_fit(s, x, y, w if s.weight_col else np.ones(150), keys(df))), abs=1e-9)


def test_a_second_fit_goes_on_from_the_first(spark):
    """Other rows, other settings: the first trees stay, and the new ones fit what they leave."""
    one, two = Boosting(rounds=4, step=0.3, max_depth=3), Boosting(rounds=3, step=0.2, max_leaves=5, seed=43)
    (x1, y1, w1), (x2, y2, w2) = made(150, 1), made(90, 2, levels=7)
    a, b = table(spark, x1, y1, w1), table(spark, x2, y2, w2)
    first = one.fit(a)
    second = two.fit(b, start=first)
    assert second.trees[:4] == first.trees and len(second.trees) == 7
    assert margins(second, b) == pytest.approx(list(plain_fit(two, x2, y2, np.ones(90), keys(b), start=margins(first, b))), abs=1e-9)
    assert margins(two.fit(b), b) != pytest.approx(margins(second, b), abs=1e-3)


def test_many_values_are_cut_at_quantiles(spark):
    x = np.stack([np.arange(3000.0), np.repeat([0.0, 1.0], 1500)], axis=1)
    edges = boosting.bin_edges(table(spark, x, x[:, 1], x[:, 1] + 1).selectExpr("features AS x"), 3)
    assert len(edges[0]) == boosting.BINS and np.diff(edges[0]).max() <= 25 and list(edges[1]) == [0.0] and list(edges[2]) == []


def test_what_it_learns_and_predicts(spark):
    x, _, w = made(2000, 3)
    df = table(spark, x, (x[:, 0] > 2) ^ (x[:, 1] > 1.5), w)  # neither feature says anything alone
    scored = Boosting(rounds=30, step=0.3, max_leaves=8).fit(df.where("i % 2 = 0")).transform(df.where("i % 2 = 1"))
    got = scored.select(F.avg((F.col("prediction") == F.col("label")).cast("int")), F.max("probability_1"), F.min("probability_1")).first()
    assert got[0] > 0.98 and got[1] < 1 and got[2] > 0
    assert scored.where((F.col("probability_1") > 0.5) != (F.col("prediction") == 1)).count() == 0


def test_one_class_constant_features_and_no_rows(spark):
    x, y, w = made(40, 1)
    ones = Boosting(rounds=3, step=0.5, max_depth=2).fit(table(spark, x * 0, y * 0 + 1, w))
    assert ones.transform(table(spark, x, y, w)).where("prediction <> 1").count() == 0
    with pytest.raises(ValueError):
        Boosting(rounds=1, step=0.1, max_depth=2).fit(table(spark, x, y, w).limit(0))
    assert BoostedTrees([]).transform(table(spark, x, y, w)).agg(F.max("margin")).first()[0] == 0


def test_row_samples_are_even():
    key = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 20_000)
    drawn = [boosting.drawn_rows(key, r, 1, 0.8) for r in range(5)]
    assert all(abs(d.mean() - 0.8) < 0.02 for d in drawn) and abs((drawn[0] & drawn[1]).mean() - 0.64) < 0.02 and drawn[0].sum() != drawn[1].sum()
    assert math.isclose(boosting.drawn_rows(key, 0, 1, 1.0).mean(), 1.0)


def test_a_task_goes_through_several_blocks(spark, monkeypatch):
    """Blocks and tasks are counted apart, with sums of several tasks, and the margins are the plain booster's."""
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 20)
    monkeypatch.setattr(boosting, "BLOCKS_OF_TASK", (3, 40))
    monkeypatch.setattr(boosting, "SUMS_OF_TASK", 20_000)
    x, y, w = made(150, 4)
    df = table(spark, x, y, w)
    slim = df.select(F.col("features").alias("x"), F.col("label").alias("y"), "w", F.xxhash64("features", "label").alias("key"))
    blocks = boosting._blocks(slim.coalesce(1), boosting.bin_edges(slim, 4), [])
    assert [r["n"] for r in blocks.select("n").collect()] == [20] * 7 + [10]
    assert boosting._tasks(8, 4) == 3 and boosting._tasks(14, 12) == 5 and boosting._tasks(135, 12) == 12 and boosting._tasks(810, 12) == 24
    s = Boosting(rounds=2, step=0.3, max_leaves=5, weight_col="w")
    assert margins(s.fit(df), df) == pytest.approx(list(plain_fit(s, x, y, w, keys(df))), abs=1e-9)


def test_a_table_of_one_block_takes_no_job_for_each_level(spark, monkeypatch):
    """Seven rounds, three to a job: besides those of the rows and their bins three jobs, and the plain booster's margins."""
    monkeypatch.setattr(boosting, "SNAPSHOT", 3)
    x, y, w = made(150, 1)
    df, s = table(spark, x, y, w), Boosting(rounds=7, step=0.3, max_depth=3, weight_col="w")
    spark.sparkContext.setJobGroup("one-block", "fit")
    try:
        model = s.fit(df)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-block"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 3 <= jobs < 20 and len(model.trees) == 7
    assert margins(model, df) == pytest.approx(list(plain_fit(s, x, y, w, keys(df))), abs=1e-9)


@pytest.mark.parametrize("s", SETTINGS)
def test_rows_that_tasks_do_not_hold_take_a_job_for_each_level(spark, s, monkeypatch):
    """The plain booster's margins there too."""
    monkeypatch.setattr(boosting, "SNAPSHOT", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 60)
    monkeypatch.setattr(boosting, "HELD_BYTES", 0)
    monkeypatch.setattr(Boosting, "_rounds_held", None)
    x, y, w = made(150, 1)
    df = table(spark, x, y, w)
    assert margins(s.fit(df.repartition(3)), df) == pytest.approx(list(plain_fit(s, x, y, w if s.weight_col else np.ones(150), keys(df))), abs=1e-9)


@pytest.mark.parametrize("max_leaves", [None, 9])
def test_all_rounds_of_several_blocks_in_one_job(spark, monkeypatch, max_leaves):
    """Tasks that hold their rows, with features of two bins that share a column and others that don't: the margins of a job for each level."""
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    x, y, w = made(300, 5)
    kind, other = np.random.default_rng(6).integers(0, 4, (2, 300))
    x = np.concatenate([x, np.stack([kind == k for k in range(4)], axis=1), (x[:, :1] > 1), np.stack([other == k for k in range(3)], axis=1), np.ones((300, 1))], axis=1).astype(float)
    y = ((x[:, 0] > 2) ^ (kind == 2) ^ (other == 1)).astype(float)
    df, s = table(spark, x, y, w), Boosting(rounds=12, step=0.3, max_depth=None if max_leaves else 4, max_leaves=max_leaves, weight_col="w")
    first = Boosting(rounds=2, step=0.3, max_depth=2).fit(df)
    monkeypatch.setattr(boosting, "HELD_BYTES", 0)
    want = s.fit(df, start=first)
    monkeypatch.undo()
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    monkeypatch.setattr(Boosting, "_best_cuts", None)
    seen, real = [], Boosting._rounds_held
    monkeypatch.setattr(Boosting, "_rounds_held", lambda self, slim, n_tasks, *more: seen.append(n_tasks) or real(self, slim, n_tasks, *more))
    model = s.fit(df, start=first)
    assert seen == [3] and model.trees[:2] == first.trees and len(model.trees) == 14
    assert margins(model, df) == pytest.approx(margins(want, df), abs=1e-9)
    if not max_leaves:
        assert margins(model, df) == pytest.approx(list(plain_fit(s, x, y, w, keys(df), start=margins(first, df))), abs=1e-9)


def test_columns_of_features_that_no_row_has_together():
    """One-hot features share a column; one that meets another starts its own."""
    hot = np.eye(3, dtype=np.uint8)[np.array([0, 1, 2, 0])]
    bins = [np.array([5, 0, 1, 2], np.uint8), *hot.T, np.array([1, 1, 0, 0], np.uint8), np.array([0, 0, 1, 0], np.uint8)]
    assert boosting._exclusive(bins, [False, True, True, True, True, True]) == [1, 4, 4, 5, 6, 6]
