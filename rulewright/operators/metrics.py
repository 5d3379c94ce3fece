"""Evaluation and selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.operators.rules import score_versions
from rulewright.operators.sampling import SplitSpec, balanced_holdout
from rulewright.sources.runs import latest_run

PRIORITY = ("f1", "acc", "sensitivity", "specificity")
NAMES = {"ACC": "acc", "F1": "f1", "SENSITIVITY": "sensitivity", "SPECIFICITY": "specificity"}


def share(a: Column, b: Column) -> Column:
    """a / b, 0 on an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(y: str = "y", p: str = "prediction") -> list[Column]:
    """tp, tn, fp, fn of label 1 against 0; other values count nowhere."""
    cells = {"tp": (1, 1), "tn": (0, 0), "fp": (0, 1), "fn": (1, 0)}
    return [F.count_if((F.col(y) == a) & (F.col(p) == b)).alias(k) for k, (a, b) in cells.items()]


def classification_metrics(df: DataFrame, keys: list[str] | tuple[str, ...] = (), y: str = "y", p: str = "prediction") -> DataFrame:
    """acc, f1, sensitivity, specificity, tp, fp, tn, fn, n and n_unexpected for each group of ``keys``.

    One aggregation for all groups: counts of (keys, y, prediction), then sums over these few cells. More than two true
    classes give the macro F1 over the union of true and predicted classes, no sensitivity and zero counts. A
    prediction outside {0, 1} of a binary truth counts as not positive and in ``n_unexpected``.
    """
    keys = list(keys)
    y_, p_ = F.col(f"`{y}`").cast("int"), F.col(f"`{p}`").cast("int")
    cells = df.groupBy(*keys, y_.alias("_y"), p_.alias("_p")).agg(F.count("*").alias("_n"))
    n = F.col("_n")
    by_class = cells.withColumn("_c", F.explode(F.array_distinct(F.array("_y", "_p"))))
    f1s = by_class.groupBy(*keys, "_c").agg(
        F.coalesce(F.sum(F.when((F.col("_y") == F.col("_c")) & (F.col("_p") == F.col("_c")), n)), F.lit(0)).alias("_tp"),
        F.sum(F.when(F.col("_y") == F.col("_c"), n).otherwise(0) + F.when(F.col("_p") == F.col("_c"), n).otherwise(0)).alias("_both"),
    )
    f1s = f1s.withColumn("_f1", share(2 * F.col("_tp"), F.col("_both"))).groupBy(*keys).agg(F.avg("_f1").alias("_macro"))

    def cell(a: int, b: int) -> Column:
        return F.coalesce(F.sum(F.when((F.col("_y") == a) & (F.col("_p") == b), n)), F.lit(0))

    sums = cells.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.countDistinct("_y").alias("_classes"),
        F.coalesce(F.sum(F.when(F.col("_y") == F.col("_p"), n)), F.lit(0)).alias("_right"),
        F.coalesce(F.sum(F.when(~F.col("_p").isin(0, 1), n)), F.lit(0)).alias("_odd"),
        F.coalesce(F.sum(F.when((F.col("_y") == 1) & (F.col("_p") != 1), n)), F.lit(0)).alias("_missed"),
        *[cell(a, b).alias(f"_{k}") for k, (a, b) in {"tp": (1, 1), "tn": (0, 0), "fp": (0, 1), "fn": (1, 0)}.items()],
    )
    both = sums.join(f1s, keys) if keys else sums.crossJoin(f1s)  # without keys each side is one row
    binary = F.col("_classes") <= 2

    def only_binary(c: Column) -> Column:
        return F.when(binary, c)

    return both.select(
        *keys,
        share(F.col("_right"), F.col("n")).alias("acc"),
        F.when(binary, share(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_missed"))).otherwise(F.col("_macro")).alias("f1"),
        only_binary(share(F.col("_tp"), F.col("_tp") + F.col("_fn"))).alias("sensitivity"),
        only_binary(share(F.col("_tn"), F.col("_tn") + F.col("_fp"))).alias("specificity"),
        *[F.coalesce(only_binary(F.col(f"_{k}")), F.lit(0)).alias(k) for k in ("tp", "fp", "tn", "fn")],
        "n",
        only_binary(F.col("_odd")).alias("n_unexpected"),
    )


def version_history(scored: DataFrame, keys: list[str] | tuple[str, ...] = ("run_id", "version", "ordinal", "split")) -> DataFrame:
    """Metrics of every version, in one pass over the long table of predictions (keys, y, prediction)."""
    return classification_metrics(scored, [k for k in keys if k in scored.columns])


def _order(priority: tuple[str, ...], columns: list[str], ordinal: str) -> list[Column]:
    names = [NAMES.get(m.upper(), m) for m in priority]
    return [F.desc_nulls_last(m) for m in names if m in columns] + [F.asc(ordinal)]


def select_best(history: DataFrame, priority: tuple[str, ...] = PRIORITY, run_cols: tuple[str, ...] = ("run_id",), ordinal: str = "ordinal") -> DataFrame:
    """The best version of each run, metric by metric; ties keep the earliest; unknown metrics decide nothing."""
    w = Window.partitionBy(*run_cols).orderBy(*_order(priority, history.columns, ordinal))
    return history.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def compare_versions(history: DataFrame, priority: tuple[str, ...] = PRIORITY, run_cols: tuple[str, ...] = ("run_id",), ordinal: str = "ordinal") -> DataFrame:
    """The rows V0, FINAL and LAST of each run side by side, in the column ``pick``."""
    w = Window.partitionBy(*run_cols)
    ranked = history.withColumns({"_first": F.row_number().over(w.orderBy(ordinal)), "_last": F.row_number().over(w.orderBy(F.desc(ordinal))), "_best": F.row_number().over(w.orderBy(*_order(priority, history.columns, ordinal)))})
    picks = F.array_compact(F.array(F.when(F.col("_first") == 1, "V0"), F.when(F.col("_best") == 1, "FINAL"), F.when(F.col("_last") == 1, "LAST")))
    return ranked.withColumn("pick", F.explode(picks)).drop("_first", "_last", "_best")


def holdout_summary(scored: DataFrame, best: DataFrame, meta: DataFrame | None = None, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Metrics of each run's chosen version on a split never used to choose it, with the run's meta data."""
    chosen = scored.join(best.select(*keys, "version"), [*keys, "version"], "left_semi")
    out = classification_metrics(chosen, [*keys, "version"])
    return out.join(meta, list(keys), "left") if meta is not None else out


def backfill_confusion(results: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Fills blank tp, fp, fn, tn of result rows from predictions of the same keys; blank where there are none."""
    counts = scored.groupBy(*keys).agg(*confusion_counts())
    counts = counts.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("tp", "fp", "fn", "tn")])
    joined = results.join(counts, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("long"), F.col(f"_{c}")) for c in ("tp", "fp", "fn", "tn")}).drop("_tp", "_fp", "_fn", "_tn")


def backfill_runs(results: DataFrame, stored: DataFrame, df: DataFrame, label_col: str, id_col: str, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """Fills blank tp, fp, fn, tn of result rows (model, seed): the test split of the row's seed is drawn again from ``df`` and
    scored by the newest run of that model and seed in ``stored`` (model, seed, run_ts, rule_json).

    Rows that have counts keep them; rows without a run stay blank. The driver reads the one rule of each blank row, and
    the rules of a seed share one scan of its split, whose size is the spec's.
    """
    keys = ["model", "seed"]
    blank = results.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("tp", "fp", "fn", "tn")])).select(*keys).distinct()
    chosen = latest_run(stored.join(blank, keys, "left_semi"), keys).orderBy(*keys).select(*keys, "rule_json").collect()
    found = None
    for seed in dict.fromkeys(r["seed"] for r in chosen):
        test = balanced_holdout(df, label_col, id_col, spec, seed).where("split = 'test'")
        scored = score_versions(test, {r["model"]: r["rule_json"] for r in chosen if r["seed"] == seed}, id_col, label_col)
        part = scored.select(F.col("version").alias("model"), F.lit(seed).cast(results.schema["seed"].dataType).alias("seed"), "y", "prediction")
        found = part if found is None else found.unionByName(part)
    return results if found is None else backfill_confusion(results, found, keys)


def format_metrics(df: DataFrame, columns: tuple[str, ...] = PRIORITY) -> DataFrame:
    """Metrics as text with three decimals, blank when missing."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.col(c))).otherwise("") for c in columns if c in df.columns})
