"""Feature drift and continual update."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulewright.operators.sampling import TwoStageSpec, two_stage_partition

#: Names of the feature column in knowledge tables.
FEATURE_HEADERS = ("feature", "features", "变量", "特征")


@dataclass(frozen=True)
class Drift:
    dropped: tuple[str, ...] = ()
    added: tuple[str, ...] = ()
    renamed: tuple[tuple[str, str], ...] = ()
    note: str = ""
    previous_run: str | None = None


@dataclass(frozen=True)
class StageSpec:
    features: tuple[str, ...]
    drift: Drift = field(default_factory=Drift)


def apply_drift(df: DataFrame, label_col: str, drift: Drift, id_col: str | None = None) -> DataFrame:
    """Renames, then drops (never label or id), then adds missing columns as NULL; the label must survive."""
    df = df.withColumnsRenamed(dict(drift.renamed))
    df = df.drop(*[c for c in drift.dropped if c not in (label_col, id_col)])
    df = df.withColumns({c: F.lit(None).cast("double") for c in drift.added if c not in df.columns}) if drift.added else df
    if label_col not in df.columns:
        raise ValueError(f"the label {label_col} is gone after the drift")
    return df


def drift_meta(df: DataFrame, drift: Drift) -> DataFrame:
    """One row: what was declared and what took effect on the columns of ``df``."""
    after = df.withColumnsRenamed(dict(drift.renamed)).columns
    row = (list(drift.dropped), [c for c in drift.dropped if c in after], list(drift.added), [c for c in drift.added if c not in after], [f"{a}->{b}" for a, b in drift.renamed], drift.note)
    return df.sparkSession.createDataFrame([row], "dropped array<string>, dropped_present array<string>, added array<string>, added_missing_filled array<string>, renamed array<string>, note string")


def drift_effects(df: DataFrame, drift: Drift) -> DataFrame:
    """(action, columns, took_effect, n_rows): each declared change with the rows whose values it removed, filled or renamed."""
    after = df.withColumnsRenamed(dict(drift.renamed)).columns
    before = {b: a for a, b in drift.renamed}
    told = [("dropped", c, c in after, F.count(f"`{before.get(c, c)}`") if c in after else F.lit(0)) for c in drift.dropped]
    told += [("added", c, c not in after, F.count("*") if c not in after else F.lit(0)) for c in drift.added]
    told += [("renamed", f"{a}->{b}", a in df.columns, F.count(f"`{a}`") if a in df.columns else F.lit(0)) for a, b in drift.renamed]
    counts = df.agg(*[n.cast("long").alias(f"n{i}") for i, (*_, n) in enumerate(told)])
    rows = [F.struct(F.lit(a).alias("action"), F.lit(c).alias("columns"), F.lit(ok).alias("took_effect"), F.col(f"n{i}").alias("n_rows")) for i, (a, c, ok, _) in enumerate(told)]
    return counts.select(F.inline(F.array(*rows)))


def select_stage(df: DataFrame, features: list[str] | tuple[str, ...], label_col: str, id_col: str | None = None) -> DataFrame:
    """Exactly the stage's features, the label and the id, in that order; the scan reads only these."""
    wanted = [*features, label_col, *([id_col] if id_col else [])]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select([F.col(f"`{c}`") for c in wanted])


def stage_view(df: DataFrame, stage: StageSpec, label_col: str, id_col: str | None = None) -> DataFrame:
    return select_stage(apply_drift(df, label_col, stage.drift, id_col), stage.features, label_col, id_col)


def strip_row_id(df: DataFrame, id_col: str) -> DataFrame:
    return df.drop(id_col)


def stage_bundles(df: DataFrame, label_col: str, id_col: str, stages: tuple[StageSpec, StageSpec], spec: TwoStageSpec, seed: int) -> dict[str, DataFrame]:
    """``stage1`` and ``stage2``: a table of train, val and test rows each, in the stage's columns."""
    parted = two_stage_partition(df, label_col, id_col, spec, seed)
    out = {}
    for k, stage in enumerate(stages, 1):
        rows = parted.where(F.col("split").endswith(str(k))).withColumn("split", F.expr("left(split, length(split) - 1)"))
        view = select_stage(apply_drift(rows, label_col, stage.drift, id_col), [*stage.features, "split"], label_col, id_col)
        out[f"stage{k}"] = view
    return out


def _renames(spark: SparkSession, drift: Drift) -> DataFrame:
    return spark.createDataFrame(list(drift.renamed), "feature string, _new string")


def carry_profile(previous: DataFrame, drift: Drift) -> DataFrame:
    """The previous profile without dropped features, renamed ones under their new name."""
    kept = previous.where(~F.col("feature").isin(list(drift.dropped))) if drift.dropped else previous
    if not drift.renamed:
        return kept
    return kept.join(_renames(previous.sparkSession, drift), "feature", "left").withColumn("feature", F.coalesce("_new", "feature")).drop("_new").select(*previous.columns)


def merge_profile(previous: DataFrame | None, new: DataFrame, drift: Drift) -> DataFrame:
    """Carried rows and the new rows of added features, by p and missing rate; ``rank`` stays as it was, ``rank_new`` is 1..n."""
    merged = new
    if previous is not None:
        merged = carry_profile(previous, drift).unionByName(new.where(F.col("feature").isin(list(drift.added))) if drift.added else new.limit(0))
    w = Window.orderBy(F.asc_nulls_last("p_value"), F.asc_nulls_last("missing_rate"), F.asc("feature"))  # a row for each feature
    return merged.withColumn("rank_new", F.row_number().over(w))


def drift_top_features(merged: DataFrame | None, k: int = 30, columns: list[str] | None = None) -> DataFrame:
    """(rank_new, feature) of the first ``k`` features; without a profile, or with an empty one, all ``columns`` in their order."""
    if columns and (merged is None or merged.isEmpty()):
        spark = SparkSession.active()
        return spark.createDataFrame(list(enumerate(columns, 1)), "rank_new int, feature string")
    return merged.orderBy("rank_new").limit(k).select("rank_new", "feature")


def parse_knowledge(runs: DataFrame, text_col: str = "text") -> DataFrame:
    """(run_id, row_no, header array, cells array) of the Markdown tables of many runs in one job.

    Lines that start and end with a pipe count; the first is the header, the second is skipped, the others are
    padded or cut to the header's width. Fewer than two such lines give no row.
    """
    lines = F.filter(F.transform(F.split(F.col(text_col), r"\r?\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & x.endswith("|") & (F.length(x) > 1))

    def cells(line: Column) -> Column:
        return F.transform(F.split(F.substring(line, F.lit(2), F.length(line) - 2), r"\|"), lambda x: F.trim(x))

    df = runs.select("run_id", lines.alias("_lines")).where(F.size("_lines") >= 2)
    df = df.select("run_id", cells(F.element_at("_lines", 1)).alias("header"), F.posexplode(F.slice("_lines", F.lit(3), F.greatest(F.size("_lines") - 2, F.lit(0)))).alias("row_no", "_line"))
    width = F.size("header")
    row = cells(F.col("_line"))
    padded = F.slice(F.concat(row, F.array_repeat(F.lit(""), width)), F.lit(1), width)
    return df.select("run_id", F.col("row_no").cast("int").alias("row_no"), "header", padded.alias("cells"))


def feature_index() -> Column:
    """0-based place of the feature column in ``header``: a known name, else the first."""
    known = F.filter(F.transform("header", lambda h, i: F.struct(F.lower(F.trim(h)).alias("h"), i.alias("i"))), lambda x: x["h"].isin(*FEATURE_HEADERS))
    return F.when(F.size(known) > 0, F.element_at(F.transform(known, lambda x: x["i"]), 1)).otherwise(F.lit(0))


def feature_of() -> Column:
    return F.get(F.col("cells"), feature_index())


def carry_knowledge(parsed: DataFrame, drift: Drift) -> DataFrame:
    """Rows of features that weren't dropped, renamed ones under their new name."""
    df = parsed.withColumn("_f", feature_of())
    df = df.where(~F.coalesce(F.col("_f").isin(list(drift.dropped)), F.lit(False))) if drift.dropped else df
    if drift.renamed:
        df = df.join(_renames(parsed.sparkSession, drift).withColumnRenamed("feature", "_f"), "_f", "left")
        at = feature_index()
        df = df.withColumn("_at", at).withColumn("cells", F.transform("cells", lambda x, i: F.when((i == F.col("_at")) & F.col("_new").isNotNull(), F.col("_new")).otherwise(x))).drop("_new", "_at")
    return df.select(*parsed.columns)


def merge_knowledge(previous: DataFrame | None, new: DataFrame, drift: Drift, run_id: str | None = None) -> DataFrame:
    """No previous rows: the new ones. Nothing added: the carried ones. Else both, run by run: new rows of added features
    follow the run's last row, in the width of its header; a run without carried rows keeps its own header.

    ``run_id`` renames the runs of the result.
    """
    if previous is None or previous.isEmpty():
        merged = new
    else:
        merged = carry_knowledge(previous, drift)
        if drift.added:
            old = merged.groupBy("run_id").agg(F.min_by("header", "row_no").alias("_header"), (F.max("row_no") + 1).alias("_next"))
            added = new.where(feature_of().isin(list(drift.added))).join(old, "run_id", "left")
            header = F.coalesce("_header", "header")
            cells = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.size(header))), F.lit(1), F.size(header))
            row_no = F.coalesce("_next", F.lit(0)) + F.col("row_no")
            merged = merged.unionByName(added.select("run_id", row_no.alias("row_no"), header.alias("header"), cells.alias("cells")))
    return merged.withColumn("run_id", F.lit(run_id)) if run_id is not None else merged


def render_knowledge(parsed: DataFrame) -> DataFrame:
    """(run_id, text): the Markdown table of each run."""

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    rule = line(F.transform("header", lambda h: F.lit("---")))
    rows = F.array_sort(F.collect_list(F.struct("row_no", line(F.col("cells")).alias("t"))))
    per = parsed.groupBy("run_id").agg(F.first("header").alias("header"), rows.alias("_r"))
    return per.select("run_id", F.array_join(F.concat(F.array(line(F.col("header")), rule), F.transform("_r", lambda x: x["t"])), "\n").alias("text"))


def drift_context(df: DataFrame, label_col: str, run_id: str, task: str, priority: tuple[str, ...], iterations: int, seed: int, drift: Drift) -> DataFrame:
    """One row that records what a run was asked to do, and the rows and positives of the table it was asked about."""
    texts = {"metric_priority": priority, "dropped": drift.dropped, "added": drift.added, "renamed": [f"{a}->{b}" for a, b in drift.renamed]}
    told = {c: F.array(*map(F.lit, v)).cast("array<string>") for c, v in texts.items()}
    told |= {"run_id": F.lit(run_id), "task": F.lit(task), "iterations": F.lit(iterations), "seed": F.lit(seed), "note": F.lit(drift.note), "previous_run": F.lit(drift.previous_run)}
    counts = df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(f"`{label_col}`") == 1).alias("n_positive"))
    return counts.withColumns(told)
