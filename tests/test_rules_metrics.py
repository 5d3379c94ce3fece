import json

import pytest
from pyspark.sql import functions as F

from rulewright.operators import errors, metrics, rules
from rulewright.sources import runs
from rulewright.streaming import scoring


def _scored(spark, tp, fn, tn, fp):
    rows = [(1, 1)] * tp + [(1, 0)] * fn + [(0, 0)] * tn + [(0, 1)] * fp
    return spark.createDataFrame(rows, "y int, prediction int")


@pytest.mark.parametrize("cells, want", [((119, 34, 226, 121), (0.69, 0.6055979643765903, 0.7777777777777778, 0.6512968299711815)), ((116, 37, 246, 101), (0.724, 0.6270270270270271, 0.7581699346405228, 0.7089337175792507))])
def test_metrics_golden(spark, cells, want):
    r = metrics.classification_metrics(_scored(spark, *cells)).first()
    assert (r["acc"], r["f1"], r["sensitivity"], r["specificity"]) == pytest.approx(want)


def test_empty_denominators_and_odd_predictions(spark):
    r = metrics.classification_metrics(spark.createDataFrame([(0, 0), (0, 2)], "y int, prediction int")).first()
    assert (r["f1"], r["sensitivity"], r["specificity"], r["n_unexpected"]) == (0.0, 0.0, 1.0, 1)


def test_best_keeps_the_earliest_of_ties(spark):
    rows = [("r", f"v{i}", i, 0.6, 0.7 if i % 2 else 0.5, None, 0.1) for i in range(10)]
    history = spark.createDataFrame(rows, "run_id string, version string, ordinal int, f1 double, acc double, sensitivity double, specificity double")
    assert metrics.select_best(history, ("F1", "unknown", "ACC")).first()["version"] == "v1"
    assert {r["pick"]: r["version"] for r in metrics.compare_versions(history).collect()} == {"V0": "v0", "FINAL": "v1", "LAST": "v9"}


def test_missing_values_fire_no_predicate(spark):
    df = spark.createDataFrame([(None, "a"), (float("nan"), "a"), (20.0, None)], "x double, s string")
    rule = {"triggers": [{"op": ">=", "col": "x", "value": 10}], "points": [{"pred": {"op": "=", "col": "s", "value": "a"}, "weight": 1}], "cutoff": 2}
    assert [r["prediction"] for r in rules.score_rules(df, rule).collect()] == [0, 0, 1]
    below = {"op": "not", "args": [{"op": ">=", "col": "x", "value": 10}]}
    of_either = {"op": "not", "args": [{"op": "or", "args": [{"op": ">=", "col": "x", "value": 10}, {"op": "=", "col": "s", "value": "b"}]}]}
    for pred in (below, of_either):
        assert [r["prediction"] for r in rules.score_rules(df, {"triggers": [pred]}).collect()] == [0, 0, 0]
    known = spark.createDataFrame([(5.0, "a"), (5.0, None)], df.schema)
    assert [r["prediction"] for r in rules.score_rules(known, {"triggers": [of_either]}).collect()] == [1, 0]


@pytest.mark.parametrize("bad", [{"triggers": [{"op": "exec", "col": "x", "value": 1}]}, {"triggers": [{"op": "=", "col": "nope", "value": 1}]}, {"code": "1"}])
def test_the_grammar_is_closed(spark, bad):
    with pytest.raises(ValueError):
        rules.score_rules(spark.createDataFrame([(1.0,)], "x double"), bad)


def test_attempts(spark):
    rows = [("r", "v1", 1, 1, "no"), ("r", "v1", 1, 2, json.dumps({"version": "v1", "error_analysis": "", "new_policy_code": "def predict_v1(f):\n    return 0"})), ("r", "v2", 2, 1, "no"), ("r", "v3", 3, 1, json.dumps({"version": "v3", "error_analysis": "", "new_policy_code": "{}"}))]
    df = spark.createDataFrame(rows, "run_id string, expected_version string, ordinal int, attempt int, raw_text string")
    got = {r["version"]: r for r in rules.resolve_attempts(rules.validate_proposals(df)).collect()}
    assert got["v1"]["accepted"] and got["v1"]["attempt"] == 2
    assert not got["v2"]["accepted"] and not got["v3"]["accepted"]


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "row_id bigint, y int, prediction int, kind string, features string")
    assert [r["line"] for r in errors.error_report(none).collect()] == ["No row is wrong."]
    gone = spark.createDataFrame([], "row_id bigint, y int")
    assert errors.regression_summary(gone).first()["message"] == "Nothing got worse."


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path):
    schema, rule = "ts timestamp, y int, x double", {"triggers": [{"op": ">", "col": "x", "value": 9}], "cutoff": 1}
    batches = [[("2024-01-01 00:10:00", 1, 10.0), ("2024-01-01 05:10:00", 0, 10.0)], [("2024-01-01 00:20:00", 1, 10.0), ("2024-01-01 05:20:00", 1, 1.0)], [("2024-01-01 09:00:00", 0, 1.0)]]
    write = lambda rows: spark.createDataFrame(rows, "ts string, y int, x double").selectExpr("CAST(ts AS timestamp) AS ts", "y", "x").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write(batches[0])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = scoring.windowed_confusion(stream, rule, "ts", "y")
    q = counted.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    for rows in batches[1:]:
        write(rows)
        q.processAllAvailable()
    q.stop()
    got = {r["start"].hour: (r["tp"], r["fp"], r["fn"]) for r in spark.table("windows").collect()}
    assert got == {0: (1, 0, 0), 5: (0, 1, 1)}  # the late row of hour 0 is in no window


def test_stream_scores_like_a_batch(spark, tmp_path):
    df = spark.range(20).select((F.col("id") % 2).cast("int").alias("y"), F.col("id").cast("double").alias("x"))
    df.write.parquet(str(tmp_path / "in"))
    rule = {"triggers": [{"op": ">", "col": "x", "value": 9}], "cutoff": 1}
    stream = scoring.score_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), rule)
    q = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").exceptAll(rules.score_rules(df, rule)).count() == 0
    assert spark.table("scored").count() == 20


def test_the_latest_of_equal_time_stamps_does_not_depend_on_order(spark):
    rows = [("a", 1, "x"), ("a", 2, "b"), ("a", 2, "c"), ("b", None, "only")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, run_ts int, v string").repartition(3)
        assert {tuple(r) for r in runs.latest_run(df, ["k"]).collect()} == {("a", 2, "c"), ("b", None, "only")}


def test_backfill_without_runs_changes_nothing(spark):
    results = spark.createDataFrame([("m", 1, None, None, None, None), ("m", 2, 1, 0, 0, 1)], "model string, seed int, tp long, fp long, fn long, tn long")
    stored = spark.createDataFrame([("m", 2, 1, "{}")], "model string, seed int, run_ts int, rule_json string")
    assert metrics.backfill_runs(results, stored, spark.createDataFrame([], "row_id int, y int"), "y", "row_id").exceptAll(results).isEmpty()
