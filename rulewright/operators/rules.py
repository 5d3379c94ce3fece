"""Rule scoring and rule versions.

A rule set is JSON in a closed grammar: ``{"triggers": [pred], "points": [{"pred": pred, "weight": w}], "cutoff": c}``, a predicate being
``{"op": "=", "col": c, "value": v}``, with ``= != < <= > >=``, ``is_null``, ``in``, or ``and``, ``or`` and ``not`` over predicates. It is compiled to
one Column, so that scoring is generated code inside the scan; text from a table is never evaluated. A rule may also be the text of a Python function
in the subset of ``python_rules``, which is compiled to a Column from its syntax tree.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.operators.python_rules import parse_rule, rule_column
from rulewright.sources.runs import append_rows, read_rows

COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}
STATUSES = ("json_parse_failed", "version_mismatch", "syntax_invalid", "function_name_mismatch", "load_failed")


def compile_predicate(pred: dict, columns: set[str] | None = None) -> Column:
    """A predicate that is false wherever a value it needs is missing (or NaN), under ``not`` too; ValueError outside the grammar."""
    return F.coalesce(_three_valued(pred, columns), F.lit(False))


def _three_valued(pred: dict, columns: set[str] | None) -> Column:
    """The predicate, null where a missing value leaves it open."""
    op = pred.get("op")
    if op in ("and", "or"):
        parts = [_three_valued(p, columns) for p in pred["args"]]
        return reduce(lambda a, b: a & b if op == "and" else a | b, parts, F.lit(op == "and"))
    if op == "not":
        return ~_three_valued(pred["args"][0], columns)
    name = pred.get("col")
    if not isinstance(name, str) or columns is not None and name not in columns:
        raise ValueError(f"unknown column: {name}")
    c = F.col(f"`{name}`")
    if op == "is_null":
        return c.isNull()
    if op == "in":
        return c.isin(list(pred["value"]))
    if op not in COMPARE or not isinstance(pred.get("value"), (int, float, str, bool)):
        raise ValueError(f"not in the grammar: {pred}")
    value = pred["value"]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        number = c.try_cast("double")
        return F.when(~F.isnan(number), COMPARE[op](number, F.lit(float(value))))
    return COMPARE[op](c.cast("string" if isinstance(value, str) else "boolean"), F.lit(value))


def compile_rules(rules: dict | str, columns: set[str] | None = None) -> Column:
    """1 if any trigger fires, else whether the points of the predicates that hold reach the cutoff; or what a Python rule returns."""
    if isinstance(rules, str) and not rules.lstrip().startswith("{"):
        return rule_column(parse_rule(rules), columns)
    rules = json.loads(rules) if isinstance(rules, str) else rules
    unknown = set(rules) - {"triggers", "points", "cutoff"}
    if unknown:
        raise ValueError(f"not in the grammar: {sorted(unknown)}")
    points = [F.when(compile_predicate(p["pred"], columns), F.lit(float(p["weight"]))).otherwise(0.0) for p in rules.get("points", [])]
    out = (reduce(lambda a, b: a + b, points) >= float(rules.get("cutoff", 1))).cast("int") if points else F.lit(0)
    triggers = [compile_predicate(p, columns) for p in rules.get("triggers", [])]
    return F.when(reduce(lambda a, b: a | b, triggers), F.lit(1)).otherwise(out) if triggers else out


def score_rules(df: DataFrame, rules: dict | str, out: str = "prediction") -> DataFrame:
    """``df`` with a prediction; works on streaming tables too."""
    return df.withColumn(out, compile_rules(rules, set(df.columns)))


def score_versions(df: DataFrame, versions: dict[str, dict | str], id_col: str, y_col: str, long: bool = True) -> DataFrame:
    """Predictions of all versions in one scan: (id, y, version, ordinal, prediction), or one column for each."""
    columns = set(df.columns)
    wide = df.select(F.col(f"`{id_col}`"), F.col(f"`{y_col}`").alias("y"), *[compile_rules(r, columns).alias(v) for v, r in versions.items()])
    if not long:
        return wide
    each = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(i).alias("ordinal"), F.col(f"`{v}`").alias("prediction")) for i, v in enumerate(versions)])
    return wide.select(f"`{id_col}`", "y", F.inline(each))


def score_python_rule(df: DataFrame, predict: Callable[[dict], int], out: str = "prediction") -> DataFrame:
    """``df`` with the prediction of a function from a row's features to an int, in Arrow batches.

    For functions that the caller registers; a rule that the grammar can say belongs in ``score_rules``.
    """
    columns = df.columns

    @F.pandas_udf(T.IntegerType())
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([int(predict(r)) for r in rows.astype(object).where(rows.notna(), None).to_dict("records")], dtype="int32")

    return df.withColumn(out, run(F.struct(*[F.col(f"`{c}`") for c in columns])))


def predict_final(df: DataFrame, rules: DataFrame, run_id: str, final_version: str, out: str = "prediction") -> DataFrame:
    """Scores with one stored version; the driver reads that row of the rule table."""
    row = rules.where((F.col("run_id") == run_id) & (F.col("version") == final_version)).select("rule_json").first()
    if row is None:
        raise ValueError(f"run {run_id} has no version {final_version}")
    return score_rules(df, row["rule_json"], out)


def inference_report(scored: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return scored.select(F.col(f"`{id_col}`"), F.col(f"`{label_col}`").alias("label"), "prediction")


def append_versions(rules: DataFrame, path: str) -> None:
    """Adds (run_id, version, ordinal, rule_json, analysis) rows; stored versions are never changed."""
    append_rows(rules.select("run_id", "version", "ordinal", "rule_json", "analysis"), path)


def read_versions(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored versions; of a version that was appended again, the first one counts."""
    return read_rows(spark, path, ["run_id", "version"], keep="first")


def current_versions(rules: DataFrame) -> DataFrame:
    """The latest version of each run."""
    return rules.groupBy("run_id").agg(F.max_by("version", "ordinal").alias("version"), F.max("ordinal").alias("ordinal"))


def _strip_fence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*|\s*```$", ""))


@F.pandas_udf(T.BooleanType())
def _compiles(code: pd.Series) -> pd.Series:
    """Whether rule JSON, or Python text, can be parsed. Parsing only: nothing is run."""
    import ast

    def ok(text: str | None) -> bool:
        if text is None:
            return False
        try:
            if text.lstrip().startswith("{"):
                json.loads(text)
            else:
                ast.parse(text)
        except (ValueError, SyntaxError, RecursionError):
            return False
        return True

    return code.map(ok)


@F.pandas_udf(T.BooleanType())
def _in_grammar(code: pd.Series) -> pd.Series:
    """Whether rule JSON keeps to the grammar, and Python text to the subset that can be compiled."""

    def predicate(p: object) -> bool:
        if not isinstance(p, dict):
            return False
        if p.get("op") in ("and", "or", "not"):
            return isinstance(p.get("args"), list) and bool(p["args"]) and all(map(predicate, p["args"]))
        return isinstance(p.get("col"), str) and (p.get("op") == "is_null" or p.get("op") == "in" and isinstance(p.get("value"), list) or p.get("op") in COMPARE and "value" in p)

    def ok(text: str | None) -> bool:
        try:
            if text and not text.lstrip().startswith("{"):
                parse_rule(text)
                return True
            rules = json.loads(text or "")
        except (ValueError, RecursionError):
            return False
        points = rules.get("points", []) if isinstance(rules, dict) else None
        return isinstance(points, list) and all(isinstance(x, dict) and predicate(x.get("pred")) and isinstance(x.get("weight"), (int, float)) for x in points) and all(map(predicate, rules.get("triggers", [])))

    return code.map(ok)


def validate_proposals(proposals: DataFrame) -> DataFrame:
    """(.., version, error_analysis, code, status) for raw proposals (run_id, expected_version, attempt, raw_text).

    Code fences go, then come in this order: JSON, version, syntax, function name, grammar; ``ok`` if none fails.
    """
    fields = "version string, error_analysis string, new_policy_code string"
    body = _strip_fence(F.col("raw_text"))
    parsed = F.from_json(body, fields, {"mode": "PERMISSIVE"})
    df = proposals.withColumn("_p", parsed)
    code = _strip_fence(F.coalesce(F.col("_p.new_policy_code"), F.lit("")))
    df = df.select("*", F.col("_p.version").alias("version"), F.col("_p.error_analysis").alias("error_analysis"), code.alias("code"))
    name = F.regexp_extract("code", r"(?m)^def\s+(\w+)\s*\(", 1)
    is_rule = F.col("code").startswith("{")
    failed = F.col("_p.version").isNull() & F.col("_p.new_policy_code").isNull()
    status = (
        F.when(F.coalesce(failed, F.lit(True)), "json_parse_failed")
        .when(~F.col("version").eqNullSafe(F.col("expected_version")), "version_mismatch")
        .when(~_compiles(F.col("code")), "syntax_invalid")
        .when(~is_rule & (name != F.concat(F.lit("predict_"), F.col("expected_version"))), "function_name_mismatch")
        .when(~_in_grammar(F.col("code")), "load_failed")
        .otherwise("ok")
    )
    return df.withColumn("status", status).drop("_p")


def resolve_attempts(validated: DataFrame, max_attempts: int = 4, ordinal: str = "ordinal") -> DataFrame:
    """(run_id, version, ordinal, accepted, attempt, statuses): the first valid attempt of each version wins.

    The first version without one stops the run: it and all later ones are not accepted.
    """
    tried = validated.where(F.col("attempt") <= max_attempts)
    logs = F.transform(F.array_sort(F.collect_list(F.struct("attempt", "status"))), lambda x: x["status"])
    per = tried.groupBy("run_id", F.col("expected_version").alias("version"), ordinal).agg(F.min(F.when(F.col("status") == "ok", F.col("attempt"))).alias("attempt"), logs.alias("statuses"))
    w = Window.partitionBy("run_id").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("accepted", F.bool_and(F.col("attempt").isNotNull()).over(w))
