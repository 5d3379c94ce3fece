"""The registered baselines have the reference's settings but for the stated shares of rounds, and its drift study's sizes."""

import pytest
from pyspark.sql import functions as F

from rulewright.operators import baselines
from rulewright.operators.boosting import BoostedTrees, Boosting
from rulewright.operators.exact_tree import ExactTree
from rulewright.operators.net import Net
from rulewright.plans import queries
from tests.conftest import DATA

SETTINGS = {
    "h8_baseline_logistic": {"maxIter": 2000},
    "h9_baseline_tree": {"task_rows": 50_000},
    "h10_baseline_mlp": {"hidden": (256, 128), "passes": 200, "batch": 256, "step": 1e-3, "l2": 1e-4, "held_out": 0.1},
    "h11_baseline_boosting_a": {"max_depth": 6, "max_leaves": None, "rounds": 60, "step": 0.3, "l2": 1.0, "row_share": 0.8, "column_share": 0.8},
    "h11_baseline_boosting_b": {"max_depth": None, "max_leaves": 64, "rounds": 60, "step": 0.3, "l2": 1.0, "row_share": 0.8, "column_share": 0.8},
}


def _settings(made, names):
    return {n: getattr(made, n) if isinstance(made, (Boosting, ExactTree, Net)) else made.getOrDefault(n) for n in names}


@pytest.mark.parametrize("name", sorted(SETTINGS))
def test_registered_settings(spark, monkeypatch, name):
    made, real = [], baselines.make_baseline

    def stop(*args, **kwargs):
        made.append(real(*args, **kwargs))
        raise RuntimeError("not fitted")

    monkeypatch.setattr(baselines, "make_baseline", stop)
    assert queries.QUERIES[name](spark, f"{DATA}/sf0.001").first()["status"] == "failed"
    assert _settings(made[0], SETTINGS[name]) == SETTINGS[name]
    spark.catalog.clearCache()


@pytest.mark.parametrize(("name", "rounds", "step"), [("h11_baseline_boosting_a", 600, 0.05), ("h11_baseline_boosting_b", 1200, 0.03)])
def test_registered_boosting_runs_all_rounds(spark, monkeypatch, name, rounds, step):
    fits = []
    monkeypatch.setattr(Boosting, "fit", lambda self, rows, start=None: fits.append(self) or 1 / 0)
    assert queries.QUERIES[name](spark, f"{DATA}/sf0.001").first()["status"] == "failed"
    assert [(f.rounds, f.step) for f in fits] == [(rounds, step)]


def test_drift_study_runs_all_rounds(spark, monkeypatch):
    """Both boostings: the first stage's rounds, the same on the shared features, and those that the second stage adds."""
    fits = []

    def fit(self, rows, start=None):
        fits.append((self.rounds, self.step, self.max_depth, start is not None))
        return BoostedTrees([])

    monkeypatch.setattr(Boosting, "fit", fit)
    two = baselines.two_stage_baselines
    monkeypatch.setattr(baselines, "two_stage_baselines", lambda one, other, *args, **kwargs: two(one, other, *args, models=("boosting_a", "boosting_b"), **kwargs))
    assert {r["status"] for r in queries.QUERIES["h12_h16_two_stage_baselines"](spark, f"{DATA}/sf0.01").collect()} == {"ok"}
    assert fits == [(200, 0.05, 5, False), (200, 0.05, 5, False), (200, 0.05, 5, True), (300, 0.05, None, False), (300, 0.05, None, False), (200, 0.05, None, True)]


def test_full_settings():
    of = lambda name, *params: _settings(baselines.make_baseline(name, 10, 3), params)
    assert of("boosting_a", "rounds", "step") == {"rounds": 600, "step": 0.05}
    assert of("boosting_b", "rounds", "step") == {"rounds": 1200, "step": 0.03}
    assert of("mlp", "passes", "held_out") == {"passes": 200, "held_out": 0.0}


@pytest.mark.parametrize("name", ["logistic", "tree", "mlp", "boosting_a", "boosting_b"])
def test_fitted_baselines_learn(spark, name):
    """A status of ok and better than chance on rows whose label follows from the features."""
    rows = [(i % 7 < 3, float(i % 7), "ab"[i % 2], int(i % 7 < 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "b boolean, x double, c string, y int").drop("b")
    got = baselines.fit_eval_baseline(name, df.where("x <> 9"), df, "y", weights="balanced", share=0.01).first()
    assert got["status"] == "ok" and got["f1"] > 0.95


def test_drift_study(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(baselines, "fit_eval_baseline", lambda name, *args, **kwargs: spark.createDataFrame([(name, kwargs["drift"])], "model string, drift boolean"))

    def tried(session, name, scored):
        try:
            scored()
        except Exception:  # nothing is fitted here
            pass
        return spark.createDataFrame([(name, True)], "model string, drift boolean")

    monkeypatch.setattr(baselines, "guarded", tried)
    monkeypatch.setattr(baselines, "prepare", lambda *args: baselines.Prepared({}, {}, None, 3))
    monkeypatch.setattr(baselines.Prepared, "transform", lambda self, df: df)
    real = baselines.make_baseline

    class Unfitted:
        def fit(self, df, start=None):
            return self

    def note(name, *args, **kwargs):
        seen[name] = real(name, *args, **kwargs)
        return seen[name] if isinstance(seen[name], Boosting) else Unfitted()

    monkeypatch.setattr(baselines, "make_baseline", note)
    two = baselines.two_stage_baselines
    stages = []
    monkeypatch.setattr(baselines, "two_stage_baselines", lambda one, other, *args, **kwargs: (stages.extend([one, other]), two(one, other, *args, **kwargs))[1])
    rows = queries.QUERIES["h12_h16_two_stage_baselines"](spark, f"{DATA}/sf0.01").collect()
    assert {(r["model"], r["stage"]) for r in rows} == {(m, s) for m in ("logistic", "tree", "mlp", "boosting_a", "boosting_b") for s in ("stage1", "stage2")} and all(r["drift"] for r in rows)
    sizes = [{r["split"]: r["count"] for r in s.groupBy("split").count().collect()} for s in stages]
    assert sizes == [{"train": 1000, "val": 500, "test": 800}, {"train": 40, "val": 500, "test": 800}]
    assert _settings(seen["boosting_a"], ["max_depth", "rounds", "step"]) == {"max_depth": 5, "rounds": 20, "step": 0.3}
    assert _settings(seen["boosting_b"], ["max_leaves", "rounds", "step", "l2"]) == {"max_leaves": 31, "rounds": 30, "step": 0.3, "l2": 0.0}
    assert _settings(real("mlp", 0, 3, drift=True), ["hidden", "batch", "held_out"]) == {"hidden": (64, 32), "batch": 64, "held_out": 0.0}
    spark.catalog.clearCache()


def test_a_failing_prediction_is_a_row_of_that_model_only(spark, monkeypatch):
    """The tree's second stage can't be applied: its row is failed, and all others are there."""
    rows = [(i, i % 5 / 2, "ab"[i % 2], int(i % 5 < 2), ("train", "test")[i % 2]) for i in range(200)]
    stage = spark.createDataFrame(rows, "row_id int, x double, c string, y int, split string")
    real = baselines.with_prior

    def broken(df, *args, **kwargs):
        return real(df, *args, **kwargs).withColumn("prior", F.raise_error(F.lit("no prediction")).cast("double"))

    monkeypatch.setattr(baselines, "with_prior", broken)
    got = baselines.two_stage_baselines(stage, stage, "y", models=("logistic", "tree", "boosting_a"), share=0.02).collect()
    status = {(r["model"], r["stage"]): r["status"] for r in got}
    assert status == {(m, s): "failed" if (m, s) == ("tree", "stage2") else "ok" for m in ("logistic", "tree", "boosting_a") for s in ("stage1", "stage2")}
    assert "no prediction" in next(r["error"] for r in got if r["status"] == "failed") and all(r["acc"] > 0.9 for r in got if r["status"] == "ok")


def test_logistic_scores_are_those_of_the_fitted_model(spark):
    """The plain Columns and Spark's own transform agree, for unseen categories and missing values too."""
    from pyspark.ml.classification import LogisticRegression

    rows = [(float(i % 7) if i % 11 else None, "abc"[i % 3], "xy"[i % 2], int(i % 7 + i % 3 > 4)) for i in range(300)]
    train = spark.createDataFrame(rows, "x double, c string, d string, y int")
    test = train.union(spark.createDataFrame([(1.0, "new", "x", 0), (None, None, None, 1)], train.schema))
    prepared = baselines.prepare(train, "y")
    model = LogisticRegression(labelCol="y", regParam=0.01).fit(prepared.transform(train))
    count = lambda df: {tuple(r)[:2]: r["count"] for r in df.groupBy("y", "prediction").count().collect()}
    assert count(baselines.predicted(prepared, model, test, "y")) == count(model.transform(prepared.transform(test)).select("y", F.col("prediction").cast("int").alias("prediction")))
