"""Feature profiling against a binary label.

The table is read once: all features are unpivoted into (feature, value, y) and combined before the shuffle into the
histogram H of counts by (feature, value). Everything else comes from H, whose size is the number of distinct
values, and the wide table is never collected. What has a row for each feature is read once, by ``per_feature``, and joined
as a local table, which Spark broadcasts by its size; so H is never shuffled by feature, only once by ranges of (feature, value) for the ranks.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.functions.pvalues import chi2_p_value, mwu_p_value, pearson_p_value
from rulewright.sources.scratch import temporary_tables, written

#: Levels shown.
MAX_LEVELS = 20


@contextmanager
def kept(df: DataFrame):
    """``df`` in memory or on disk while the block runs."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def per_feature(df: DataFrame) -> DataFrame:
    """A result with a row for each feature, or each of its few bins, as a local table: computed once, as large as the table is wide."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Odds ratio of the 2x2 table with half a case added to each cell."""
    return ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5))


def coerce_numeric(col: Column) -> Column:
    """A double; what can't be parsed, and NaN, is missing."""
    x = col.try_cast("double")
    return F.when(~F.isnan(x), x)


def histogram(df: DataFrame, label_col: str, features: list[str] | None = None) -> DataFrame:
    """H: (ordinal, feature, is_number, num, txt, n, c1, c0), one row for each value, and for the missing one, of each feature."""
    features = features or [c for c in df.columns if c != label_col]
    parts, about = [], []
    for i, c in enumerate(features):
        kind = df.schema[c].dataType
        number, whole = isinstance(kind, T.NumericType), isinstance(kind, T.IntegralType)
        col = F.col(f"`{c}`").cast("int").cast("string") if isinstance(kind, T.BooleanType) else F.col(f"`{c}`")
        # a number's text is only needed for levels and comes from the number; a text's number is parsed once for each distinct text
        num, txt = (coerce_numeric(col), F.lit(None)) if number else (F.lit(None), col)
        parts.append(F.struct(F.lit(i).alias("ordinal"), num.cast("double").alias("num"), txt.cast("string").alias("txt")))
        about.append(F.struct(F.lit(c).alias("feature"), F.lit(number).alias("is_number"), F.lit(whole).alias("whole")))
    long = df.select(F.col(f"`{label_col}`").cast("int").alias("_y"), F.inline(F.array(*parts)))
    sums = F.count("*").alias("n"), F.count_if(F.col("_y") == 1).alias("c1"), F.count_if(F.col("_y") == 0).alias("c0")
    counted = long.groupBy("ordinal", "num", "txt").agg(*sums).withColumn("num", F.coalesce("num", coerce_numeric(F.col("txt"))))
    told = F.get(F.array(*about), F.col("ordinal"))
    return counted.select("ordinal", *[told[c].alias(c) for c in ("feature", "is_number", "whole")], "num", "txt", "n", "c1", "c0")


def _missing() -> Column:
    return F.when(F.col("is_number"), F.col("num").isNull()).otherwise(F.col("txt").isNull())


def classify_features(h: DataFrame) -> DataFrame:
    """(ordinal, feature, feature_type, missing_rate, n_valid, n_unique) of each feature (B1, B2)."""
    ok = ~_missing()
    zero_one = F.coalesce(F.col("num").isin(0.0, 1.0), F.lit(False))
    per = h.groupBy("ordinal", "feature", "is_number").agg(
        F.sum("n").alias("_total"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("n_valid"),
        F.count_if(ok).alias("n_unique"),
        F.coalesce(F.bool_and(F.when(ok, zero_one)), F.lit(True)).alias("_zero_one"),
    )
    binary = (F.col("n_unique") <= 2) & F.col("_zero_one")
    kind = F.when(binary, "binary").when(F.col("is_number"), "continuous").otherwise("categorical")
    return per.select("ordinal", "feature", kind.alias("feature_type"), ((F.col("_total") - F.col("n_valid")) / F.col("_total")).alias("missing_rate"), "n_valid", "n_unique")


def _running(batches):
    """``within``: the rows with a smaller value of the feature in this task, from batches sorted by (ordinal, num)."""
    ordinal, total = None, 0
    for batch in batches:
        of, n = batch["ordinal"].to_numpy(), batch["n"].to_numpy()
        if not len(n):
            continue
        before = np.cumsum(n) - n
        first = np.concatenate([[0], np.nonzero(of[1:] != of[:-1])[0] + 1])
        base = before[first]
        base[0] -= total if of[0] == ordinal else 0
        before -= np.repeat(base, np.diff(np.append(first, len(n))))
        ordinal, total = of[-1], int(before[-1] + n[-1])
        yield batch.append_column("within", pa.array(before, pa.int64()))


def cumulative(values: DataFrame) -> DataFrame:
    """H rows of numbers with ``before``, the number of rows with a smaller value of the feature.

    A sample sort: Spark deals (feature, value) out by ranges of its own sample and sorts inside them, each task adds up its rows, and what
    the tasks before it hold of the feature is added by a join with a row for each task and feature. No task sorts a whole
    feature and nothing grows with the number of distinct values but H itself.
    """
    placed = values.repartitionByRange("ordinal", "num").sortWithinPartitions("ordinal", "num")
    placed = placed.mapInArrow(_running, T.StructType([*values.schema.fields, T.StructField("within", T.LongType())])).withColumn("_part", F.spark_partition_id())
    placed = written(placed, "ordered-values")
    parts = placed.groupBy("ordinal", "_part").agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy("ordinal").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("ordinal", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return placed.join(offsets, ["ordinal", "_part"]).withColumn("before", F.col("within") + F.col("_base")).drop("within", "_part", "_base")


def _at(q: float, high: bool) -> Column:
    """The value at the position (n - 1) q, rounded down or up, of a cumulative histogram."""
    pos = (F.col("n_valid") - 1) * F.lit(q)
    k = F.ceil(pos) if high else F.floor(pos)
    return F.min(F.when(F.col("before") + F.col("n") > k, F.col("num")))


def quantiles(cum: DataFrame, **wanted: float) -> DataFrame:
    """(ordinal, a column for each wanted share), exact and linear between two values, from a cumulative histogram."""
    ends = cum.groupBy("ordinal", "n_valid").agg(*[_at(q, high).alias(f"_{name}{int(high)}") for name, q in wanted.items() for high in (False, True)])

    def between(name: str, q: float) -> Column:
        pos = (F.col("n_valid") - 1) * F.lit(q)
        return F.col(f"_{name}0") + (F.col(f"_{name}1") - F.col(f"_{name}0")) * (pos - F.floor(pos))

    return ends.select("ordinal", *[between(name, q).alias(name) for name, q in wanted.items()])


def numeric_summary(h: DataFrame, kinds: DataFrame, cum: DataFrame | None = None) -> DataFrame:
    """(ordinal, mean, std, median, min, max, q1, q3) of the continuous features; the quantiles are exact."""
    values = _continuous(h, kinds)
    cum = cumulative(values) if cum is None else cum
    mean = (F.sum(F.col("num") * F.col("n")) / F.sum("n")).alias("mean")
    means = per_feature(values.groupBy("ordinal").agg(mean, F.sum("n").alias("_n"), F.min("num").alias("min"), F.max("num").alias("max")))
    spread = values.join(means, "ordinal").groupBy("ordinal").agg(F.sum(F.col("n") * F.pow(F.col("num") - F.col("mean"), 2)).alias("_m2"))
    std = F.when(F.col("_n") > 1, F.sqrt(F.col("_m2") / (F.col("_n") - 1)))
    found = means.join(per_feature(spread), "ordinal").join(per_feature(quantiles(cum, q1=0.25, median=0.5, q3=0.75)), "ordinal")
    return found.select("ordinal", "mean", std.alias("std"), "median", "min", "max", "q1", "q3")


def _continuous(h: DataFrame, kinds: DataFrame) -> DataFrame:
    wanted = F.broadcast(kinds.where("feature_type = 'continuous'").select("ordinal", "n_valid"))
    return h.where(F.col("is_number") & F.col("num").isNotNull()).join(wanted, "ordinal").select("ordinal", "num", "n", "c1", "c0", "n_valid")


def level_counts(h: DataFrame, kinds: DataFrame, max_levels: int = MAX_LEVELS) -> DataFrame:
    """(ordinal, level_counts json) of binary and categorical features: the largest levels, then ``__OTHER__``."""
    levels = _levels(h, kinds)
    # rank within the feature: a per-task top-k first (limit of the window), so long tails stay local
    w = Window.partitionBy("ordinal").orderBy(F.desc("n"), F.asc("level"))
    ranked = levels.withColumn("_rank", F.row_number().over(w))
    top = ranked.where(F.col("_rank") <= max_levels)
    totals = levels.groupBy("ordinal").agg(F.sum("n").alias("_all"))
    entries = top.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("_rank", "level", "n"))).alias("_e"), F.sum("n").alias("_shown")).join(totals, "ordinal")
    kept = F.transform("_e", lambda x: F.struct(x["level"].alias("key"), x["n"].alias("value")))
    rest = F.when(F.col("_all") > F.col("_shown"), F.array(F.struct(F.lit("__OTHER__").alias("key"), (F.col("_all") - F.col("_shown")).alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:bigint>>"))
    made = entries.select("ordinal", F.to_json(F.map_from_entries(F.concat(kept, rest))).alias("level_counts"))
    wanted = kinds.where("feature_type <> 'continuous'").select("ordinal")
    return wanted.join(made, "ordinal", "left").withColumn("level_counts", F.coalesce("level_counts", F.lit("{}")))


def _levels(h: DataFrame, kinds: DataFrame) -> DataFrame:
    wanted = F.broadcast(kinds.where("feature_type <> 'continuous'").select("ordinal"))
    text = F.when(F.col("is_number"), F.when(F.col("whole"), F.col("num").cast("bigint").cast("string")).otherwise(F.col("num").cast("string"))).otherwise(F.col("txt"))
    return h.where(~_missing()).join(wanted, "ordinal").select("ordinal", "feature", text.alias("level"), "n", "c1", "c0")


def point_biserial(h: DataFrame, kinds: DataFrame) -> DataFrame:
    """(ordinal, n, n1, n0, pointbiserial_r, direction) of the continuous features; a constant gives null and ``neg``."""
    values = _continuous(h, kinds)
    y = F.col("c1") + F.col("c0")
    base = per_feature(values.groupBy("ordinal").agg((F.sum(F.col("num") * y) / F.sum(y)).alias("_mx"), F.sum("c1").alias("n1"), F.sum("c0").alias("n0")))
    my = F.col("n1") / (F.col("n1") + F.col("n0"))
    dx = F.col("num") - F.col("_mx")
    sums = values.join(base, "ordinal").groupBy("ordinal", "n1", "n0").agg(F.sum(y * dx * dx).alias("_xx"), F.sum(dx * (F.col("c1") * (1 - my) - F.col("c0") * my)).alias("_xy"))
    yy = F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0"))
    r = F.when((F.col("_xx") > 0) & (yy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_xy") / F.sqrt(F.col("_xx") * yy))))
    n = F.col("n1") + F.col("n0")
    direction = F.when(n < 2, "").when(r >= 0, "pos").otherwise("neg")
    return sums.select("ordinal", n.alias("n"), "n1", "n0", r.alias("pointbiserial_r"), direction.alias("direction"))


def mann_whitney_u(cum: DataFrame) -> DataFrame:
    """(ordinal, mwu_u, ties, n1, n0): U of the values where y = 1, from average ranks; null if a sample is empty."""
    n, c1 = F.col("n").cast("double"), F.col("c1").cast("double")
    per = cum.groupBy("ordinal").agg(F.sum(c1 * (F.col("before") + (n + 1) / 2)).alias("_ranks"), F.sum(n * n * n - n).alias("ties"), F.sum("c1").alias("n1"), F.sum("c0").alias("n0"))
    u = F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("_ranks") - F.col("n1").cast("double") * (F.col("n1") + 1) / 2)
    return per.select("ordinal", u.alias("mwu_u"), "ties", F.col("n1").alias("u_n1"), F.col("n0").alias("u_n0"))


def chi_square(h: DataFrame, kinds: DataFrame) -> DataFrame:
    """(ordinal, chi2_stat, chi2_df) of binary and categorical features, with Yates' correction for 2x2."""
    levels = _levels(h, kinds)
    per = per_feature(levels.groupBy("ordinal").agg(F.count("*").alias("_k"), F.sum("c1").alias("_n1"), F.sum("c0").alias("_n0")))
    n, rows = (F.col("_n1") + F.col("_n0")).cast("double"), (F.col("c1") + F.col("c0")).cast("double")

    def cell(seen: str, of: str) -> Column:
        expected = rows * F.col(of) / n
        gap = F.abs(F.col(seen) - expected)
        gap = gap - F.when(F.col("_k") == 2, F.least(F.lit(0.5), gap)).otherwise(0.0)
        return gap * gap / expected

    sums = levels.join(per, "ordinal").groupBy("ordinal", "_k", "_n1", "_n0").agg(F.sum(F.when((F.col("_n1") > 0) & (F.col("_n0") > 0), cell("c1", "_n1") + cell("c0", "_n0"))).alias("_stat"))
    both = (F.col("_n1") > 0) & (F.col("_n0") > 0)
    return sums.select("ordinal", F.when(both & (F.col("_k") >= 2), F.col("_stat")).when(both, 0.0).alias("chi2_stat"), F.when(both, F.col("_k") - 1).alias("chi2_df"))


def quartile_odds_ratio(h: DataFrame, kinds: DataFrame, summary: DataFrame) -> DataFrame:
    """(ordinal, bin, n_bins, odds) and the text of B8: odds ratios of the quartile bins against the first one."""
    edges = F.array_distinct(F.array("min", "q1", "median", "q3", "max")).alias("_edges")
    values = _continuous(h, kinds).join(F.broadcast(summary.select("ordinal", edges)), "ordinal")
    binned = values.withColumn("bin", F.greatest(F.size(F.filter("_edges", lambda e: e < F.col("num"))), F.lit(1)))
    counts = binned.groupBy("ordinal", F.size("_edges").alias("_k"), "bin").agg(F.sum("c1").alias("a"), F.sum("c0").alias("b")).where("_k > 2")
    first = F.max(F.when(F.col("bin") == 1, F.struct("a", "b"))).over(Window.partitionBy("ordinal"))
    odds = F.when(F.col("bin") == 1, F.lit(1.0)).otherwise(odds_ratio(F.col("a"), F.col("b"), F.col("_f.a"), F.col("_f.b")))
    return counts.withColumn("_f", first).select("ordinal", "bin", (F.col("_k") - 1).alias("n_bins"), odds.alias("odds"))


def quartile_text(bins: DataFrame) -> DataFrame:
    part = F.concat(F.lit("Q"), F.col("bin").cast("string"), F.lit("="), F.format_string("%.2f", "odds"))
    return bins.groupBy("ordinal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", part.alias("t")))), lambda x: x["t"]), "; ").alias("binned_or_q4_rel_to_q1"))


def contingency_table(df: DataFrame, x: str, y: str, wide: bool = False) -> DataFrame:
    """Counts of (x, y) on complete rows, long or with a column for each y."""
    rows = df.where(F.col(f"`{x}`").isNotNull() & F.col(f"`{y}`").isNotNull())
    return rows.groupBy(F.col(f"`{x}`").alias("x")).pivot(y).count().na.fill(0) if wide else rows.groupBy(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y")).agg(F.count("*").alias("n"))


def choose_test(df: DataFrame) -> DataFrame:
    """method, statistic and p_value: point-biserial, unless its p is missing or Mann-Whitney's is smaller."""
    mwu = F.col("mwu_p").isNotNull() & (F.col("pointbiserial_p").isNull() | (F.col("mwu_p") < F.col("pointbiserial_p")))
    return df.withColumns({
        "method": F.when(mwu, "mwu").otherwise("pointbiserial"),
        "statistic": F.when(mwu, F.col("mwu_u")).otherwise(F.col("pointbiserial_r")),
        "p_value": F.when(mwu, F.col("mwu_p")).otherwise(F.col("pointbiserial_p")),
    })


def rank_features(profile: DataFrame) -> DataFrame:
    """rank 1..n by p, missing rate and column order; missing p last. One row for each feature."""
    w = Window.orderBy(F.asc_nulls_last("p_value"), F.asc("missing_rate"), F.asc("ordinal"))
    return profile.withColumn("rank", F.row_number().over(w))


FIELDS = ("rank", "feature", "feature_type", "n_valid", "method", "statistic", "p_value", "direction", "missing_rate", "mean", "std", "median", "min", "max", "n_unique", "level_counts", "pointbiserial_r", "pointbiserial_p", "mwu_u", "mwu_p", "chi2_stat", "chi2_p", "binned_or_q4_rel_to_q1", "method_note")


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of the columns' numbers; None for a column without a number. One pass over the table, then the sort of its distinct values."""
    numbers = df.select(F.lit(0).alias("_y"), *[coerce_numeric(F.col(f"`{c}`")).alias(c) for c in columns])
    h = histogram(numbers, "_y", columns).where("num IS NOT NULL").select("ordinal", "num", "n")
    with temporary_tables():
        ordered = cumulative(h)
        totals = ordered.groupBy("ordinal").agg(F.sum("n").alias("n_valid"))
        found = {r["ordinal"]: r["median"] for r in quantiles(ordered.join(totals, "ordinal"), median=0.5).collect()}
    return {c: found.get(i) for i, c in enumerate(columns)}


def profile_table(df: DataFrame, label_col: str, features: list[str] | None = None) -> DataFrame:
    """All statistics, a row for each feature (B15), computed when called. H is kept while its passes run."""
    with kept(histogram(df, label_col, features)) as h, temporary_tables():
        kinds = per_feature(classify_features(h))
        cum = cumulative(_continuous(h, kinds))
        summary, ranks = per_feature(numeric_summary(h, kinds, cum)), per_feature(mann_whitney_u(cum))
        numbers = kinds.where("feature_type = 'continuous'").drop("n_unique")
        for part in (summary, per_feature(point_biserial(h, kinds)), ranks, per_feature(quartile_text(quartile_odds_ratio(h, kinds, summary)))):
            numbers = numbers.join(part, "ordinal", "left")
        numbers = numbers.withColumns({
            "pointbiserial_p": pearson_p_value("pointbiserial_r", "n"),
            "mwu_p": mwu_p_value("mwu_u", "u_n1", "u_n0", "ties"),
            "binned_or_q4_rel_to_q1": F.coalesce("binned_or_q4_rel_to_q1", F.lit("")),
            "direction": F.coalesce("direction", F.lit("")),
            "method_note": F.lit(""),
        })
        numbers = choose_test(numbers)
        others = kinds.where("feature_type <> 'continuous'").join(per_feature(level_counts(h, kinds)), "ordinal", "left")
        others = others.join(per_feature(chi_square(h, kinds)), "ordinal", "left")
        p = F.when(F.col("chi2_df") == 0, F.lit(1.0)).otherwise(chi2_p_value("chi2_stat", "chi2_df"))
        others = others.withColumn("chi2_p", F.when(F.col("chi2_stat").isNotNull(), p))
        fixed = {"method": F.lit("chi2"), "statistic": F.col("chi2_stat"), "p_value": F.col("chi2_p"), "direction": F.lit(""), "method_note": F.lit("")}
        others = others.withColumns(fixed)
        return per_feature(rank_features(numbers.unionByName(others, allowMissingColumns=True)).select(*FIELDS))


def top_features(profile: DataFrame, k: int = 30) -> DataFrame:
    """(rank, feature, summary) of the first k features."""
    text = F.concat_ws(", ", F.concat(F.lit("rank="), F.col("rank").cast("string")), F.concat(F.lit("feature="), "feature"), F.concat(F.lit("type="), "feature_type"), F.concat(F.lit("method="), "method"), F.concat(F.lit("p="), F.when(F.col("p_value").isNotNull(), F.format_string("%.3g", "p_value")).otherwise("nan")), F.concat(F.lit("missing="), F.format_string("%.3f", "missing_rate")))
    return profile.orderBy("rank").limit(k).select("rank", "feature", text.alias("summary"))
