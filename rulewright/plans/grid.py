"""Experiment grids and reports (I1-I9): all cells in one shuffle instead of one process for each."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulewright.functions.hashing import hash_order
from rulewright.operators.metrics import classification_metrics, format_metrics
from rulewright.operators.sampling import ratio_targets
from rulewright.sources.runs import flags_of
from rulewright.sources.scratch import settings, written

SEEDS = (36, 40, 42)
TRAIN_SIZES = (3000, 1000, 500, 100, 50, 10)
#: Training totals and class ratios (positive, negative) of the imbalance study.
TOTALS = (1000, 3000)
RATIOS = ((1, 1), (1, 2), (2, 1), (1, 5), (5, 1), (1, 10), (10, 1), (1, 50), (50, 1))


def experiment_grid(spark: SparkSession, **dimensions: list) -> DataFrame:
    """The product of the named dimensions with a ``cell_id``: a few hundred rows of parameters, made on the driver."""
    rows = [(i, *cell) for i, cell in enumerate(product(*dimensions.values()))]
    return spark.createDataFrame(rows, ["cell_id", *dimensions])


def ratio_grid(found: DataFrame, totals: tuple[int, ...] = TOTALS, ratios: tuple[tuple[int, int], ...] = RATIOS, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """(cell_id, columns of ``found``, total, p, n, seed): each row of ``found``, the values that a table holds of a dimension, with
    every total, ratio and seed. Cells are numbered in the order of these; a grid is small enough for one task."""
    cells = [F.struct(F.lit(t).alias("total"), F.lit(p).alias("p"), F.lit(n).alias("n"), F.lit(s).alias("seed")) for t in totals for p, n in ratios for s in seeds]
    rows = found.select("*", F.posexplode(F.array(*cells)).alias("_at", "_cell"))
    place = F.row_number().over(Window.orderBy(*found.columns, "_at")) - 1
    return rows.select(place.cast("long").alias("cell_id"), *found.columns, "_cell.*")


def filter_grid(grid: DataFrame, **wanted: list) -> DataFrame:
    """Cells with the wanted values; an error if none is left."""
    for name, values in wanted.items():
        if values:
            grid = grid.where(F.col(name).isin(list(values)))
    if grid.isEmpty():
        raise ValueError("no cell is left")
    return grid


def cell_targets(grid: DataFrame, total: str = "total", p: str | None = None, n: str | None = None) -> DataFrame:
    """(cell columns, label, target): balanced halves, or by a ratio p:n."""
    size = F.col(total).cast("int")
    pos, neg = ratio_targets(size, F.col(p), F.col(n)) if p else ((size / 2).cast("int"), (size / 2).cast("int"))
    pair = F.array(F.struct(F.lit(1).alias("label"), pos.alias("target")), F.struct(F.lit(0).alias("label"), neg.alias("target")))
    return grid.select("*", F.inline(pair))


def first_ranks(pool: DataFrame, most: int, seeds: list[int], label_col: str, id_col: str) -> DataFrame:
    """(seed, label, id, rank) of the first ``most`` rows of each seed and class in hash order.

    One scan: each task keeps its own first rows of every (seed, class) before the shuffle (the limit of a ranked window, which
    Spark applies up to a set rank), so a class that holds nearly all rows sends no more than ``most`` from a task.
    """
    spark = pool.sparkSession
    each = F.explode(F.array(*[F.lit(s).cast("int") for s in seeds])).alias("seed")
    rows = pool.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("label"), each)
    rows = rows.where("label IS NOT NULL").withColumn("_h", hash_order(F.col("seed"), "cells", F.col("_id")))
    rank = F.row_number().over(Window.partitionBy("seed", "label").orderBy("_h", "_id"))
    ranked = rows.withColumn("_rank", rank).where(F.col("_rank") <= most).select("seed", "label", "_id", "_rank")
    with settings(spark, spark__sql__optimizer__windowGroupLimitThreshold=str(most + 1)):
        return written(ranked, "cell-ranks")


def sample_cells(pool: DataFrame, targets: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """(cell_id, seed, draw_id, id, y): every cell's draws, ``target`` of each class.

    A class with enough rows is drawn without replacement, nested by hash rank; a smaller one with replacement, its draw numbers
    being hashed to ranks. All cells are one equi-join of their draws with the ranked rows; a class without rows gives none.
    """
    need = targets.agg(F.max("target").alias("most"), F.array_sort(F.collect_set("seed")).alias("seeds")).first()
    counts = pool.groupBy(F.col(f"`{label_col}`").cast("int").alias("label")).agg(F.count("*").alias("_have"))
    ranked = first_ranks(pool, int(need["most"] or 0), need["seeds"] or [0], label_col, id_col)
    draws = targets.select("cell_id", "seed", "label", "target").where("target > 0").join(counts, "label")
    draws = draws.select("*", F.explode(F.sequence(F.lit(1), F.col("target").cast("int"))).alias("draw_id"))
    hashed = hash_order(F.col("seed"), "draws", F.concat_ws(".", "cell_id", "label", "draw_id"))
    again = F.pmod(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint"), F.col("_have")) + 1
    draws = draws.withColumn("_rank", F.when(F.col("_have") >= F.col("target"), F.col("draw_id")).otherwise(again).cast("int"))
    joined = draws.join(ranked, ["seed", "label", "_rank"])
    return joined.select("cell_id", "seed", "draw_id", F.col("_id").alias(id_col), F.col("label").alias("y"))


def sampling_audit(pool: DataFrame, targets: DataFrame, label_col: str) -> DataFrame:
    """(cell_id, label, target, available, replaced): whether a cell needs draws with replacement."""
    counts = pool.groupBy(F.col(f"`{label_col}`").cast("int").alias("label")).agg(F.count("*").alias("available"))
    return targets.select("cell_id", "label", "target").join(counts, "label", "left").select("cell_id", "label", "target", F.coalesce("available", F.lit(0)).alias("available"), (F.coalesce("available", F.lit(0)) < F.col("target")).alias("replaced"))


def evaluate_cells(scored: DataFrame, grid: DataFrame, keys: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Metrics of every cell in one aggregation; a cell without rows, or with fewer than its column ``total`` says, is a row with its
    status, not an exception."""
    measured = classification_metrics(scored, keys or ["cell_id"])
    status = F.when(F.col("n").isNull(), "no_rows")
    status = status.when(F.col("n") < F.col(total), "short") if total else status
    return grid.join(measured, keys or ["cell_id"], "left").withColumn("status", status.otherwise("ok"))


def order_of(col: Column, known: list[str]) -> Column:
    """Place in the display order, from 0; unknown ones are 99."""
    at = F.array_position(F.array(*[F.lit(x) for x in known]), col)
    return F.when(at > 0, at - 1).otherwise(99)


def order_report(results: DataFrame, orders: dict[str, list[str]]) -> DataFrame:
    """Results in the fixed display order of the named columns."""
    return results.orderBy(*[x for c, known in orders.items() for x in (order_of(F.col(c).cast("string"), [str(k) for k in known]), F.col(c))])


def ablation_report(index: DataFrame, summaries: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Each ablation run's flags, size and status beside its held-out metrics as text."""
    u, k = flags_of(F.col("name"))
    joined = index.withColumns({"use_profile": u, "use_knowledge": k}).join(summaries, run_col, "left")
    return format_metrics(joined.withColumn("status", F.when(F.col("n").isNull(), "missing").otherwise("ok")))


def repeat_runs(grid: DataFrame, seeds: list[int]) -> DataFrame:
    """The grid once for each seed, with the number of the run; seeds are given and recorded."""
    each = F.array(*[F.struct(F.lit(i).alias("run_no"), F.lit(s).alias("seed")) for i, s in enumerate(seeds)])
    return grid.drop("seed").select("*", F.inline(each)).withColumn("cell_id", F.col("cell_id") * len(seeds) + F.col("run_no"))


def combine_results(rules: DataFrame, baselines: DataFrame) -> DataFrame:
    return rules.unionByName(baselines, allowMissingColumns=True)
