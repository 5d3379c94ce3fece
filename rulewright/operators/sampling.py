"""Reproducible splits and samples in hash order.

The first n of a class in hash order are one ``orderBy(hash).limit(n)``: each task keeps its own n, so a class that holds
nearly all rows is no bottleneck. Draw sizes are stated by the caller and small against the pool.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.functions.hashing import hash_order
from rulewright.sources.tables import with_row_id


@dataclass(frozen=True)
class SplitSpec:
    test_total: int = 1000
    val_total: int = 1000
    pos_value: int = 1
    neg_value: int = 0


def class_counts(df: DataFrame, label_col: str) -> dict[int, int]:
    """Rows of each class; the driver gets one number for each."""
    return {r["y"]: r["n"] for r in df.groupBy(F.col(f"`{label_col}`").cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}


def first_by_hash(df: DataFrame, n: int, seed: int, salt: str, id_col: str) -> DataFrame:
    return df.orderBy(hash_order(seed, salt, id_col), F.col(f"`{id_col}`")).limit(n)


def _ranked(df: DataFrame, n: int, seed: int, salt: str, id_col: str, rank: str = "_rank") -> DataFrame:
    """The first n rows with their rank 1..n: the window sees these n rows only."""
    w = Window.orderBy(hash_order(seed, salt, id_col), F.col(f"`{id_col}`"))
    return first_by_hash(df, n, seed, salt, id_col).withColumn(rank, F.row_number().over(w))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _of_class(df: DataFrame, label_col: str, value: int) -> DataFrame:
    return df.where(F.col(f"`{label_col}`").cast("int") == value)


def balanced_holdout(df: DataFrame, label_col: str, id_col: str, spec: SplitSpec = SplitSpec(), seed: int = 42) -> DataFrame:
    """The held-out rows with ``split`` test or val, half of each class: in hash order test comes first, then val.

    ValueError if a class has fewer rows than both need.
    """
    test, val = spec.test_total // 2, spec.val_total // 2
    counts = class_counts(df, label_col)
    for value in (spec.pos_value, spec.neg_value):
        if counts.get(value, 0) < test + val:
            raise ValueError(f"class {value} has {counts.get(value, 0)} rows, {test + val} are needed")
    parts = [_ranked(_of_class(df, label_col, v), test + val, seed, f"holdout{v}", id_col) for v in (spec.pos_value, spec.neg_value)]
    return _union(parts).withColumn("split", F.when(F.col("_rank") <= test, "test").otherwise("val")).drop("_rank")


def remainder_pool(df: DataFrame, holdout: DataFrame, id_col: str) -> DataFrame:
    """Rows not held out; the ids of the holdout are of a stated, small number and Spark broadcasts them by size."""
    return df.join(holdout.select(id_col), id_col, "left_anti")


def sample_random(pool: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """n rows without replacement; ValueError if n isn't positive or the pool is too small."""
    if n <= 0:
        raise ValueError("n must be positive")
    size = pool.count()
    if size < n:
        raise ValueError(f"the pool has {size} rows, {n} are needed")
    return first_by_hash(pool, n, seed, "random", id_col)


def _draw(pool: DataFrame, n: int, available: int, seed: int, salt: str, id_col: str) -> DataFrame:
    """n rows with a draw_id: without replacement if there are enough, else by hashed draw numbers."""
    if available >= n:
        return _ranked(pool, n, seed, salt, id_col, "draw_id")
    ranked = _ranked(pool, available, seed, salt, id_col)
    draw = F.conv(F.substring(hash_order(seed, salt, F.col("draw_id")), 1, 8), 16, 10).cast("bigint")
    draws = pool.sparkSession.range(1, n + 1).select(F.col("id").alias("draw_id")).withColumn("_rank", F.pmod(draw, F.lit(available)) + 1)
    return draws.join(ranked, "_rank").drop("_rank").select(*pool.columns, F.col("draw_id").cast("int").alias("draw_id"))


def sample_by_class(pool: DataFrame, targets: dict[int, int], label_col: str, id_col: str, seed: int) -> tuple[DataFrame, list[dict]]:
    """(rows with a draw_id, meta for each class); a class that is too small is drawn with replacement."""
    counts = class_counts(pool, label_col)
    empty = [v for v in targets if not counts.get(v)]
    if empty:
        raise ValueError(f"classes without rows: {empty}")
    parts = [_draw(_of_class(pool, label_col, v), n, counts[v], seed, f"class{v}", id_col) for v, n in targets.items()]
    return _union(parts), sampling_meta(targets, counts)


def sample_balanced(pool: DataFrame, n: int, label_col: str, id_col: str, seed: int, classes: tuple[int, int] = (1, 0)) -> tuple[DataFrame, list[dict]]:
    """n/2 rows of each class; n must be even and positive."""
    if n <= 0 or n % 2:
        raise ValueError("n must be even and positive")
    return sample_by_class(pool, dict.fromkeys(classes, n // 2), label_col, id_col, seed)


def ratio_targets(total: Column, p: Column, n: Column) -> tuple[Column, Column]:
    """(positives, negatives): total * p / (p + n), half to even, between 1 and total - 1."""
    pos = F.greatest(F.lit(1), F.least(total - 1, F.bround(total * p / (p + n), 0).cast("int")))
    return pos, total - pos


def counts_from_ratio(total: int, p: int, n: int) -> tuple[int, int]:
    """As ``ratio_targets`` for one cell; ValueError if total or p + n isn't positive."""
    if total <= 0 or p + n <= 0:
        raise ValueError("total and the ratio's sum must be positive")
    pos = min(max(round(total * p / (p + n)), 1), total - 1)
    return pos, total - pos


def sample_ratio(pool: DataFrame, total: int, p: int, n: int, label_col: str, id_col: str, seed: int) -> tuple[DataFrame, list[dict]]:
    pos, neg = counts_from_ratio(total, p, n)
    return sample_by_class(pool, {1: pos, 0: neg}, label_col, id_col, seed + total + 1000 * p + n)


@dataclass(frozen=True)
class TwoStageSpec:
    train1: int
    train2: int
    val_total: int
    test_total: int

    def cuts(self) -> list[tuple[str, int]]:
        """(split, rows of each class) in the order in which the permutation is cut."""
        v, t = self.val_total // 2, self.test_total // 2
        return [("train1", self.train1 // 2), ("val1", v), ("test1", t), ("train2", self.train2 // 2), ("val2", v), ("test2", t)]


def two_stage_partition(df: DataFrame, label_col: str, id_col: str, spec: TwoStageSpec, seed: int) -> DataFrame:
    """One labelled table of six disjoint, balanced splits: each class's hash order cut at running totals."""
    if spec.train1 % 2 or spec.train2 % 2:
        raise ValueError("train sizes must be even")
    need = sum(n for _, n in spec.cuts())
    counts = class_counts(df, label_col)
    if min(counts.get(1, 0), counts.get(0, 0)) < need:
        raise ValueError(f"each class needs {need} rows, there are {counts}")
    ranked = _union([_ranked(_of_class(df, label_col, v), need, seed, f"stage{v}", id_col) for v in (1, 0)])
    split, end = F.lit(None).cast("string"), need
    for name, n in reversed(spec.cuts()):
        split = F.when(F.col("_rank") <= end, name).otherwise(split)
        end -= n
    return ranked.withColumn("split", split).drop("_rank")


def sampling_meta(targets: dict[int, int], counts: dict[int, int]) -> list[dict]:
    return [{"label": v, "target": n, "available": counts.get(v, 0), "replaced": counts.get(v, 0) < n} for v, n in sorted(targets.items())]


def split_row_ids(split: DataFrame, id_col: str, as_list: bool = False) -> DataFrame:
    """The long table (split, id); ``as_list``: (split, ids) with sorted ids, for splits of a stated, small size."""
    long = split.select("split", F.col(f"`{id_col}`"))
    return long.groupBy("split").agg(F.array_sort(F.collect_list(id_col)).alias("ids")) if as_list else long


def validate_splits(splits: DataFrame, id_col: str, sizes: dict[str, int], required: list[str] = (), forbidden: list[str] = ()) -> DataFrame:
    """(problem, split, detail): wrong sizes, missing and forbidden columns, up to 10 ids in more than one split."""
    spark = splits.sparkSession
    known = [("missing_column", "*", c) for c in required if c not in splits.columns] + [("forbidden_column", "*", c) for c in forbidden if c in splits.columns]
    columns = spark.createDataFrame(known, "problem string, split string, detail string")
    wanted = spark.createDataFrame(list(sizes.items()), "split string, want int")
    have = splits.groupBy("split").agg(F.count("*").alias("have"))
    size = wanted.join(have, "split", "full").where(~F.col("want").eqNullSafe(F.coalesce("have", F.lit(0)))).select(F.lit("size").alias("problem"), "split", F.concat_ws("/", F.coalesce("have", F.lit(0)).cast("string"), F.col("want").cast("string")).alias("detail"))
    twice = splits.groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.array_sort(F.collect_set("split")).alias("_in")).where(F.size("_in") > 1)
    overlap = twice.orderBy("_id").limit(10).select(F.lit("overlap").alias("problem"), F.array_join("_in", "+").alias("split"), F.col("_id").cast("string").alias("detail"))
    return columns.unionByName(size).unionByName(overlap)


def shuffle_rows(df: DataFrame, seed: int, id_col: str) -> DataFrame:
    """Hash order, for exports only."""
    return df.orderBy(hash_order(seed, "shuffle", id_col), F.col(f"`{id_col}`"))


def shuffled_places(df: DataFrame, seed: int, id_col: str, name: str = "place") -> DataFrame:
    """``df`` with the place of each row in hash order, from 1, numbered by ranges and not in one task."""
    hashed = df.withColumn("_hash", hash_order(seed, "shuffle", id_col))
    return with_row_id(hashed, ["_hash", id_col], name).withColumn(name, F.col(name) + 1).drop("_hash")
