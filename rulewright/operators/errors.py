"""Errors of a version and regressions between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.functions.hashing import hash_order


def misclassified(df: DataFrame, features: list[str], id_col: str = "row_id", y: str = "y", p: str = "prediction", binary: bool = True) -> DataFrame:
    """(id, y, prediction, kind, features) of the rows that are wrong: FP for (0, 1), else FN; ERR for multi-class truth."""
    kind = F.when((F.col(y) == 0) & (F.col(p) == 1), "FP").otherwise("FN") if binary else F.lit("ERR")
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in features])) if features else F.lit("{}")
    return df.where(F.col(y) != F.col(p)).select(F.col(f"`{id_col}`"), F.col(y).alias("y"), F.col(p).alias("prediction"), kind.alias("kind"), row.alias("features"))


def sample_errors(errors: DataFrame, most: int, seed: int, id_col: str = "row_id") -> DataFrame:
    """All errors, or ``most`` of them in hash order: a per-task top-k, no count needed. 0 or less keeps all."""
    return errors.orderBy(hash_order(seed, "errors", id_col), id_col).limit(most) if most > 0 else errors


def error_report(errors: DataFrame, id_col: str = "row_id", max_details: int = 40) -> DataFrame:
    """(line_no, line): a header with totals, the first ``max_details`` errors by id, a note on those left out."""
    total = errors.agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "FP").alias("fp"), F.count_if(F.col("kind") == "FN").alias("fn"))
    counted = (F.col("fp") + F.col("fn") == F.col("n")) & (F.col("n") > 0)
    head = F.when(F.col("n") == 0, "No row is wrong.").when(counted, F.format_string("%d rows are wrong: %d FP, %d FN", "n", "fp", "fn")).otherwise(F.format_string("%d rows are wrong", "n"))
    note = F.format_string("%d more are left out.", F.col("n") - max(0, max_details))
    lines = total.select(F.lit(0).cast("long").alias("line_no"), head.alias("line")).unionByName(total.where(F.col("n") > max_details).select(F.lit(2**40).alias("line_no"), note.alias("line")))
    first = errors.orderBy(id_col).limit(max(0, max_details))
    detail = F.format_string("- id=%s kind=%s y=%s prediction=%s features=%s", F.col(f"`{id_col}`").cast("string"), "kind", F.col("y").cast("string"), F.col("prediction").cast("string"), "features")
    return lines.unionByName(first.select(F.row_number().over(Window.orderBy(id_col)).cast("long").alias("line_no"), detail.alias("line")))


def regressed(old: Column, new: Column, y: Column) -> Column:
    return (old == y) & (new != y)


def regressions(wide: DataFrame, old: str, new: str, id_col: str = "row_id", extra: list[str] | None = None) -> DataFrame:
    """(id, y, prediction_old, prediction_new, ..) of rows that ``old`` had right and ``new`` has wrong: a filter, no join."""
    hit = regressed(F.col(f"`{old}`"), F.col(f"`{new}`"), F.col("y"))
    return wide.where(hit).select(F.col(f"`{id_col}`"), "y", F.col(f"`{old}`").alias("prediction_old"), F.col(f"`{new}`").alias("prediction_new"), *(extra or []))


def regression_examples(found: DataFrame, most: int, seed: int, id_col: str = "row_id") -> DataFrame:
    return found.orderBy(hash_order(seed, "regressions", id_col), id_col).limit(max(0, most))


def regression_summary(found: DataFrame, id_col: str = "row_id", most: int = 20) -> DataFrame:
    """(n_regressed, ids, n_more, message): the smallest ``most`` ids come from a per-task top-k."""
    n = found.agg(F.count("*").alias("n_regressed"))
    first = found.select(id_col).orderBy(id_col).limit(most).agg(F.array_sort(F.collect_list(id_col)).alias("ids"))
    more = F.col("n_regressed") - F.size("ids")
    text = F.when(F.col("n_regressed") == 0, "Nothing got worse.").otherwise(
        F.concat(F.format_string("%d rows got worse: ", "n_regressed"), F.array_join(F.col("ids").cast("array<string>"), ", "), F.when(more > 0, F.format_string(" and %d more", more)).otherwise(""))
    )
    return n.crossJoin(first).select("n_regressed", "ids", more.alias("n_more"), text.alias("message"))  # one row each


def version_diff_all(long: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(version_old, version_new, ordinal, n_fixed, n_regressed) of consecutive versions from (id, y, version, ordinal, prediction); ids are unique."""
    w = Window.partitionBy(f"`{id_col}`").orderBy("ordinal")
    both = long.withColumns({"_old": F.lag("prediction").over(w), "version_old": F.lag("version").over(w)}).where("version_old IS NOT NULL")
    y, old, new = F.col("y"), F.col("_old"), F.col("prediction")
    return both.groupBy("version_old", F.col("version").alias("version_new"), "ordinal").agg(F.count_if(regressed(new, old, y)).alias("n_fixed"), F.count_if(regressed(old, new, y)).alias("n_regressed"))


def version_diff_wide(wide: DataFrame, versions: list[str]) -> DataFrame:
    """As ``version_diff_all`` from one column for each version: one aggregation, no shuffle of rows."""
    y = F.col("y")
    sums = []
    for a, b in zip(versions, versions[1:]):
        old, new = F.col(f"`{a}`"), F.col(f"`{b}`")
        sums += [F.count_if(regressed(new, old, y)).alias(f"fixed_{b}"), F.count_if(regressed(old, new, y)).alias(f"regressed_{b}")]
    rows = [F.struct(F.lit(a).alias("version_old"), F.lit(b).alias("version_new"), F.lit(i).alias("ordinal"), F.col(f"fixed_{b}").alias("n_fixed"), F.col(f"regressed_{b}").alias("n_regressed")) for i, (a, b) in enumerate(zip(versions, versions[1:]), 1)]
    return wide.agg(*sums).select(F.inline(F.array(*rows)))


def iteration_log(resolved: DataFrame, regressed_counts: DataFrame) -> DataFrame:
    """(run_id, version, ordinal, accepted, statuses, last_accepted_version, last_regressed).

    ``regressed_counts``: (run_id, version, n_regressed); the ids stay a table of ``regressions``, since a run may have very
    many. A version that failed repeats what came before it.
    """
    w = Window.partitionBy("run_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    df = resolved.join(regressed_counts, ["run_id", "version"], "left")
    ok = F.col("accepted")
    last = F.last(F.when(ok, F.col("version")), ignorenulls=True).over(w).alias("last_accepted_version")
    regressed_ = F.last(F.when(ok, F.coalesce("n_regressed", F.lit(0))), ignorenulls=True).over(w).alias("last_regressed")
    return df.select("run_id", "version", "ordinal", "accepted", "statuses", last, regressed_)
