import pytest
from pyspark.sql import functions as F

from rulewright.operators import baselines, drift, rules, sampling
from rulewright.plans import grid
from rulewright.sources import runs, tables


@pytest.fixture(scope="module")
def pool(spark):
    return spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 8 == 0).cast("int").alias("y"), (F.col("id") * 1.5).alias("x"))


def test_holdout_is_balanced_and_stable(pool):
    spec = sampling.SplitSpec(40, 20)
    a = sampling.balanced_holdout(pool, "y", "row_id", spec, 1)
    b = sampling.balanced_holdout(pool.repartition(7), "y", "row_id", spec, 1)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    assert {(r["split"], r["y"]): r["count"] for r in a.groupBy("split", "y").count().collect()} == {("test", 1): 20, ("test", 0): 20, ("val", 1): 10, ("val", 0): 10}
    assert sampling.remainder_pool(pool, a, "row_id").count() == 340
    with pytest.raises(ValueError):
        sampling.balanced_holdout(pool, "y", "row_id", sampling.SplitSpec(100, 20))


def test_small_classes_are_drawn_with_replacement(pool):
    rows, meta = sampling.sample_balanced(pool, 120, "y", "row_id", 3)
    assert [m["replaced"] for m in meta] == [False, True]
    assert rows.groupBy("y").count().orderBy("y").collect()[1]["count"] == 60
    for bad in (0, 3):
        with pytest.raises(ValueError):
            sampling.sample_balanced(pool, bad, "y", "row_id", 3)
    assert sampling.counts_from_ratio(10, 1, 3) == (2, 8)  # half to even
    assert sampling.counts_from_ratio(10, 0, 3) == (1, 9)


def test_two_stages_are_disjoint(pool):
    parts = sampling.two_stage_partition(pool, "y", "row_id", sampling.TwoStageSpec(20, 10, 10, 10), 5)
    assert parts.count() == parts.select("row_id").distinct().count() == 70
    assert sampling.validate_splits(parts, "row_id", {"train1": 20, "val1": 10, "test1": 10, "train2": 10, "val2": 10, "test2": 10}).count() == 0


def test_row_ids(pool):
    got = tables.with_row_id(pool.select("x", "y"), ["x"], "n").collect()
    assert sorted((r["n"], r["x"]) for r in got) == [(i, i * 1.5) for i in range(400)]
    with pytest.raises(ValueError):
        tables.with_row_id(pool, ["x"], "X")


def test_contract(spark, pool):
    other = pool.withColumnRenamed("x", "z")
    with pytest.raises(ValueError):
        tables.check_contract(pool, other, "y", "row_id")
    with pytest.raises(ValueError):
        tables.check_contract(pool, pool.withColumn("y", F.lit("no")), "y", "row_id")


def test_tables_and_runs(spark, pool, tmp_path):
    pool.withColumn("x", F.when(F.col("row_id") == 0, F.lit(float("nan"))).otherwise(F.col("x"))).coalesce(1).write.option("header", True).csv(str(tmp_path / "t.csv"))
    df = tables.load_table(spark, str(tmp_path / "t.csv"))
    assert df.where("x IS NULL").count() == 1
    profile = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.7)], "rank int, feature string, p_value double")
    path = str(tmp_path / "profiles")
    assert runs.profile_or_fallback(spark, path, "r1", ["a", "b", "c"]) == (["a", "b", "c"], None)
    runs.write_profile(profile, path, "r1")
    assert runs.profile_or_fallback(spark, path, "r1", [], 1)[0] == ["a"]
    assert runs.snapshot_previous(spark, path, "r1", "r2", profile).count() == 2
    assert runs.read_profile(spark, path, "r2", "prev").count() == 2
    assert runs.snapshot_previous(spark, path, "none", "r3", profile).count() == 0
    runs.write_profile(profile.limit(1), path, "r1")  # again: the last one counts
    assert runs.read_profile(spark, path, "r1").count() == 1 and runs.read_profile(spark, path, "r2", "prev").count() == 2
    log = str(tmp_path / "log")
    for _ in range(2):
        runs.append_eval_log(profile, log)
    assert runs.read_eval_log(spark, log, ["feature"]).count() == 2
    profile.withColumn("feature", F.lit("half")).write.parquet(f"{log}/data/attempt=killed")  # no commit record
    assert {r["feature"] for r in runs.read_eval_log(spark, log, ["feature"]).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        runs.read_rows(spark, log, ["feature"], "any")
    runs.write_results(profile, str(tmp_path / "res"))
    runs.write_manifest(profile, str(tmp_path / "man"))
    assert spark.read.json(str(tmp_path / "man")).count() == 2


def test_drift(spark, pool):
    d = drift.Drift(dropped=("x", "y"), added=("z",), renamed=(("row_id", "id"),))
    assert drift.apply_drift(pool, "y", d, "id").columns == ["id", "y", "z"]
    with pytest.raises(ValueError, match="missing"):
        drift.select_stage(pool, ["x", "nope"], "y")
    text = spark.createDataFrame([("r", "a\n| 特征 | s |\n|--|--|\n| f1 | x | more |\n| f2 |\nend"), ("e", "| only |")], "run_id string, text string")
    parsed = drift.parse_knowledge(text)
    assert [r["cells"] for r in parsed.orderBy("row_no").collect()] == [["f1", "x"], ["f2", ""]]
    kept = drift.carry_knowledge(parsed, drift.Drift(dropped=("f2",), renamed=(("f1", "g"),)))
    assert drift.render_knowledge(kept).first()["text"] == "| 特征 | s |\n| --- | --- |\n| g | x |"
    assert [r["feature"] for r in drift.drift_top_features(None, 1, ["a", "b"]).collect()] == ["a", "b"]
    two = parsed.unionByName(parsed.withColumns({"run_id": F.lit("q"), "header": F.array(F.lit("f"), F.lit("s"), F.lit("t")), "cells": F.array(F.lit("f1"), F.lit(""), F.lit("z"))}))
    merged = drift.merge_knowledge(two, parsed, drift.Drift(added=("f2",)))
    assert {r["run_id"]: (len(r["header"]), r["n"]) for r in merged.groupBy("run_id", "header").agg(F.count("*").alias("n")).collect()} == {"r": (2, 3), "q": (3, 2)}
    assert merged.groupBy("run_id", "row_no").count().where("count > 1").count() == 0


def test_encodings(spark):
    train = spark.createDataFrame([("b", 1.0, None), ("a", 3.0, None), ("a", None, None)], "c string, n double, gone double")
    meta = baselines.encoding_metadata(train)
    got = baselines.apply_encoding(spark.createDataFrame([("b", None), ("z", 9.0)], "c string, n double"), meta).collect()
    assert [(r["c"], r["n"], r["gone"]) for r in got] == [(1.0, 2.0, 0.0), (-1.0, 9.0, 0.0)]
    ids = baselines.index_with_unknown(train, spark.createDataFrame([("a",), ("q",), (None,)], "c string"), ["c"])
    assert sorted(r["c"] for r in ids.collect()) == [0, 0, 1]
    failed = baselines.fit_eval_baseline("tree", train.limit(0).withColumn("y", F.lit(1)), train.withColumn("y", F.lit(1)), "y").first()
    assert failed["status"] == "failed" and failed["error"]


def test_grid(spark):
    cells = grid.experiment_grid(spark, a=[1, 2], b=["x"], seed=[36, 40])
    assert cells.count() == 4 and grid.filter_grid(cells, a=[2]).count() == 2
    with pytest.raises(ValueError):
        grid.filter_grid(cells, a=[9])


def test_cells_of_too_small_a_pool(spark):
    """Every cell is of full size, draws and audit agree, and a class that suffices has no repeats; a class without rows leaves the cell short."""
    pool = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "id long, y int")
    cells = grid.ratio_grid(spark.createDataFrame([("t",)], "task string"), (300, 60), ((50, 1), (1, 50), (1, 2)), (36, 42))
    targets = grid.cell_targets(cells, p="p", n="n")
    drawn = grid.sample_cells(pool, targets, "y", "id").collect()
    audit = {(r["cell_id"], r["label"]): r for r in grid.sampling_audit(pool, targets, "y").collect()}
    by_cell = {}
    for r in drawn:
        by_cell.setdefault((r["cell_id"], r["y"]), []).append(r["id"])
    assert {k: len(v) for k, v in by_cell.items()} == {k: r["target"] for k, r in audit.items()} and any(r["replaced"] for r in audit.values())
    for k, ids in by_cell.items():
        assert (len(set(ids)) < len(ids)) == audit[k]["replaced"] and len(set(ids)) > 0.5 * min(len(ids), audit[k]["available"])
    scored = grid.sample_cells(pool.where("y = 0"), targets, "y", "id").withColumn("prediction", F.lit(0))
    assert {r["status"] for r in grid.evaluate_cells(scored, cells.drop("n"), total="total").collect()} == {"short"}


def test_stored_versions_survive_repetition(spark, tmp_path):
    path, schema = str(tmp_path / "rules"), "run_id string, version string, ordinal int, rule_json string, analysis string"
    assert rules.read_versions(spark, path) is None
    for text in ("first", "second"):
        rules.append_versions(spark.createDataFrame([("r", "v0", 0, text, None)], schema), path)
    rules.append_versions(spark.createDataFrame([("r", "v1", 1, "x", "a"), (None, "v0", 0, "y", "a")], schema), path)
    assert {(r["run_id"], r["version"]): r["rule_json"] for r in rules.read_versions(spark, path).collect()} == {("r", "v0"): "first", ("r", "v1"): "x", (None, "v0"): "y"}


def test_runs_are_found_by_their_paths(spark, tmp_path):
    root = str(tmp_path)
    rows = [("a", 1000, 1, 50, 42, "20240101_000000", "old"), ("a", 1000, 1, 50, 42, "20240201_000000", "new"), ("a", 1000, 50, 1, 42, "20230101_000000", "other"), ("b", 10, 1, 1, 36, "20240101_000000", '{"x": [1]}')]
    runs.write_run_files(spark.createDataFrame(rows, "dataset string, total int, p int, n int, seed int, run_ts string, rule_json string"), root)
    (tmp_path / "note.txt").write_text("not a run")
    assert runs.find_runs(spark, root).count() == 4
    got = {(r["dataset"], r["total"], r["p"], r["n"], r["seed"]): (r["run_ts"], r["rule_json"]) for r in runs.newest_rules(spark, root).collect()}
    assert got == {("a", 1000, 1, 50, 42): ("20240201_000000", "new"), ("a", 1000, 50, 1, 42): ("20230101_000000", "other"), ("b", 10, 1, 1, 36): ("20240101_000000", '{"x": [1]}')}


def test_very_many_categories(spark):
    """100,000 categories: an index a row and a plan that names none of them."""
    n = 100_000
    train = spark.range(n).select(F.format_string("c%06d", "id").alias("c"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("d"))
    df = spark.createDataFrame([("c000000", "y"), ("c099999", "x"), ("new", "z"), (None, None)], "c string, d string")
    hot, first = baselines.sparse_one_hot(train, df, ["c", "d"])
    assert first == {"c": 0, "d": n}
    assert sorted(tuple(r["hot"]["indices"]) for r in hot.collect()) == sorted([(0, n + 1), (n - 1, n), (), (0, n)]) and hot.first()["hot"]["size"] == n + 2
    assert len(hot._jdf.queryExecution().analyzed().toString()) < 20_000
    assert len(baselines.one_hot(train, df.limit(1), ["c"]).first()["c"]) == n


def test_two_threads_keep_their_own_tables(spark):
    """A block that ends in one thread leaves the tables of a block in another alone, and the session gets its settings back."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from rulewright.sources import scratch

    before, both = {k: spark.conf.get(k) for k in scratch.SETTINGS}, Barrier(2, timeout=60)

    def run(i):
        with scratch.temporary_tables():
            df = scratch.written(spark.range(10 + i), f"thread{i}")
            both.wait()
            if i:
                with scratch.temporary_tables():
                    pass
            path = df.inputFiles()[0]
            n = df.count()
            both.wait()
        return n, path

    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(run, range(2)))
    assert [n for n, _ in found] == [10, 11] and {k: spark.conf.get(k) for k in scratch.SETTINGS} == before
    assert not any(__import__("os").path.exists(p.removeprefix("file://").removeprefix("file:")) for _, p in found)
