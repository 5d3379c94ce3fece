"""Tables of runs: profiles, evaluation logs, results, manifests, latest runs."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


COMMIT = "attempt string, committed_at long"


def append_rows(rows: DataFrame, path: str) -> None:
    """Adds rows to a store so that they count at once or not at all: they are written under an attempt of their own, and a commit
    record names the attempt when all of them are there. A write that is killed half-way leaves rows that no reader sees."""
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{path}/data/attempt={attempt}")
    spark.createDataFrame([(attempt, time.time_ns())], COMMIT).coalesce(1).write.mode("append").json(f"{path}/commits")


def read_rows(spark: SparkSession, path: str, keys: list[str], keep: str = "last") -> DataFrame | None:
    """The committed rows, or None if there are none. Of several attempts that hold a key the ``first`` or the ``last`` committed counts, so a
    repeated append changes nothing. Attempts are a small table that is joined; rows are shuffled by key only to choose."""
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    try:
        commits = spark.read.schema(COMMIT).json(f"{path}/commits")
        data = spark.read.option("mergeSchema", True).parquet(f"{path}/data")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    committed = data.withColumn("attempt", F.col("attempt").cast("string")).join(commits, "attempt")
    pick = (F.min if keep == "first" else F.max)(F.struct("committed_at", "attempt")).alias("_chosen")
    chosen = committed.groupBy(*keys).agg(pick).select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_chosen.attempt").alias("_attempt"))
    same = F.col("attempt") == F.col("_attempt")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return committed.join(chosen, same, "left_semi").drop("attempt", "committed_at")


def write_profile(profile: DataFrame, path: str, run_id: str, kind: str = "new") -> None:
    """Adds the probe table of one run; written again, it takes the earlier one's place."""
    append_rows(profile.withColumns({"run_id": F.lit(run_id), "kind": F.lit(kind)}), path)


def read_profile(spark: SparkSession, path: str, run_id: str, kind: str = "new") -> DataFrame | None:
    """The probe table of a run, or None if it has none."""
    df = read_rows(spark, path, ["run_id", "kind"])
    if df is None:
        return None
    df = df.where((F.col("run_id") == run_id) & (F.col("kind") == kind)).drop("run_id", "kind")
    return None if df.isEmpty() else df


def profile_or_fallback(spark: SparkSession, path: str, run_id: str, columns: list[str], top_k: int = 30) -> tuple[list[str], DataFrame | None]:
    """(features, profile): the saved profile's first ``top_k`` features, or all columns and no profile."""
    df = read_profile(spark, path, run_id)
    if df is None:
        return columns, None
    return [r["feature"] for r in df.orderBy("rank").limit(top_k).select("feature").collect()], df


def snapshot_previous(spark: SparkSession, path: str, previous_run: str, run_id: str, empty_like: DataFrame) -> DataFrame:
    """Copies the previous run's table beside the new one as kind ``prev``; empty when there is none."""
    df = read_profile(spark, path, previous_run)
    df = empty_like.limit(0) if df is None else df
    write_profile(df, path, run_id, "prev")
    return df


def append_eval_log(metrics: DataFrame, path: str) -> None:
    """Adds one row for each version with its metrics."""
    append_rows(metrics, path)


def read_eval_log(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The log with one row for each of the keys, the last one committed."""
    return read_rows(spark, path, keys)


def write_results(results: DataFrame, path: str, fmt: str = "csv") -> None:
    """The result table as CSV with a header or as Parquet. One row for each model and cell, so one file."""
    writer = results.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON object for each stage."""
    manifest.coalesce(1).write.mode("overwrite").json(path)


def latest_run(runs: DataFrame, keys: list[str], ts_col: str = "run_ts") -> DataFrame:
    """The newest row of each key, by the run's time stamp, all columns kept; of equal time stamps the row last in order of its JSON."""
    rest = F.struct(*[F.col(f"`{c}`") for c in runs.columns if c not in keys])
    best = runs.groupBy(*keys).agg(F.max_by(rest, F.struct(F.col(f"`{ts_col}`"), F.to_json(rest))).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.`{c}`").alias(c) for c in runs.columns if c not in keys])


#: Folders of a run below a root: the data set, the training rows, the ratio and the seed, then the time stamp.
RUN_PATH = r"/([^/]+)/train_(\d+)/ratio_(\d+)_(\d+)/seed_(\d+)/(\d{8}_\d{6})/"


def write_run_files(rules: DataFrame, root: str) -> None:
    """One folder for each row (dataset, total, p, n, seed, run_ts, rule_json) in the layout of ``RUN_PATH``; a driver's job, a folder for each run."""
    for r in rules.toLocalIterator():
        folder = f"{root}/{r['dataset']}/train_{r['total']}/ratio_{r['p']}_{r['n']}/seed_{r['seed']}/{r['run_ts']}"
        rules.sparkSession.createDataFrame([(r["rule_json"],)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/rules")


def find_runs(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, total, p, n, seed, run_ts, path) of every rule file below ``root``, from its path alone; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root).select("path")
    at = [F.regexp_extract("path", RUN_PATH, i + 1) for i in range(6)]
    names, kinds = ("dataset", "total", "p", "n", "seed", "run_ts"), ("string", "int", "int", "int", "int", "string")
    return files.where(F.col("path").rlike(RUN_PATH)).select(*[c.cast(kind).alias(name) for c, name, kind in zip(at, names, kinds, strict=True)], "path")


def newest_rules(spark: SparkSession, root: str) -> DataFrame:
    """The newest run of each (dataset, total, p, n, seed) below ``root`` with its rule text: newest by the folder's time stamp."""
    found = latest_run(find_runs(spark, root), ["dataset", "total", "p", "n", "seed"])
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    return found.join(texts.select("path", F.regexp_replace(F.col("content").cast("string"), r"\n$", "").alias("rule_json")), "path")


def read_result_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All ``results_<seed>.csv`` below ``folder`` in one scan, each row with the seed of its file's path."""
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    return rows.select("*", seed_of(F.col("_metadata.file_path")).alias("seed"))


def seed_of(file_name: Column) -> Column:
    """The seed in a name such as ``results_42.csv``, or in the path of a part of such a folder."""
    return F.regexp_extract(file_name, r"_(\d+)\.csv(/[^/]*)?$", 1).try_cast("int")


def ratio_of(model: Column) -> tuple[Column, Column]:
    """(p, n) of a model name such as ``rules(1:50)``."""
    return tuple(F.regexp_extract(model, r"\((\d+):(\d+)\)", g).try_cast("int") for g in (1, 2))


def flags_of(name: Column) -> tuple[Column, Column]:
    """(U, K) of a name such as ``U1_K0``: whether the run used the profile and the knowledge table."""
    return tuple(F.regexp_extract(name, p, 1).try_cast("int") for p in (r"U([01])", r"K([01])"))
