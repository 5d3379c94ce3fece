"""Feature preparation and baseline classifiers: Spark ML's logistic regression, exact trees, nets, and boosting by histograms."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.operators.boosting import Boosting
from rulewright.operators.exact_tree import ExactTree
from rulewright.operators.metrics import classification_metrics
from rulewright.operators.net import Net
from rulewright.operators.profile import coerce_numeric, medians
from rulewright.sources.scratch import temporary_tables, written
from rulewright.sources.tables import with_row_id


def column_kinds(df: DataFrame, exclude: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """(categorical, numeric) columns: text and booleans against numbers."""
    cat = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in exclude]
    return cat, [c for c in df.columns if c not in cat and c not in exclude]


def column_values(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(column, kind, n_values, n_missing): the kinds with what the columns hold, in one aggregation."""
    cat, num = column_kinds(df, exclude)
    held = df.agg(F.count("*").alias("_rows"), *[F.count(f"`{c}`").alias(f"_{i}") for i, c in enumerate([*cat, *num])])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit("categorical" if c in cat else "numeric").alias("kind"), F.col(f"_{i}").alias("n_values"), (F.col("_rows") - F.col(f"_{i}")).alias("n_missing"))
        for i, c in enumerate([*cat, *num])
    ]
    return held.select(F.inline(F.array(*rows)))


def numeric_stats(train: DataFrame, columns: list[str]) -> dict[str, dict[str, float | None]]:
    """Exact median, and mean and population deviation after filling with it. Medians come from the histogram's prefix
    sums, so no task holds all values of a column."""
    if not columns:
        return {}
    med = medians(train, columns)
    full = [F.coalesce(coerce_numeric(F.col(f"`{c}`")), F.lit(med[c] or 0.0)) for c in columns]
    rest = train.agg(*[f(v).alias(f"{f.__name__}{i}") for i, v in enumerate(full) for f in (F.avg, F.stddev_pop)]).first()
    return {c: {"median": med[c], "mean": rest[2 * i], "std": rest[2 * i + 1]} for i, c in enumerate(columns)}


def impute_scale(df: DataFrame, stats: dict[str, dict[str, float | None]]) -> DataFrame:
    """Train median for missing, then (x - mean) / population deviation; a constant column becomes 0."""

    def scaled(c: str, s: dict) -> Column:
        filled = F.coalesce(coerce_numeric(F.col(f"`{c}`")), F.lit(s["median"] or 0.0))
        return (filled - F.lit(s["mean"] or 0.0)) / F.lit(s["std"] or 1.0)

    return df.withColumns({c: scaled(c, s) for c, s in stats.items()})


def modes(train: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The most frequent value of each text column; ties go to the smallest."""
    if not columns:
        return {}
    row = train.agg(*[F.mode(F.col(f"`{c}`").cast("string"), True).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def impute_modes(df: DataFrame, found: dict[str, str | None]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(m or "")) for c, m in found.items()}) if found else df


def _numbered(train: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(column, value, code): the distinct values of each column, numbered from 0 in sorted order.

    Values are range-sorted and numbered by task, so a column of very many values never meets in one task or row.
    """
    each = [F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in values.items()]
    long = train.select(F.inline(F.array(*each))).where("value IS NOT NULL").distinct()
    placed = with_row_id(long, ["column", "value"], "_place")
    first = F.broadcast(placed.groupBy("column").agg(F.min("_place").alias("_first")))  # a row for each column
    return placed.join(first, "column").select("column", "value", (F.col("_place") - F.col("_first")).alias("code"))


def encoding_metadata(train: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(column, kind, value, code): sorted codes of each text column's values, and each number's median (0 if all missing)."""
    cat, num = column_kinds(train, exclude)
    spark = train.sparkSession
    stats = numeric_stats(train, num)
    out = spark.createDataFrame([(c, "numeric", None, float(stats[c]["median"] or 0.0)) for c in num], "column string, kind string, value string, code double")
    if not cat:
        return out
    codes = _numbered(train, {c: F.col(f"`{c}`").cast("string") for c in cat})
    return out.unionByName(codes.select("column", F.lit("categorical").alias("kind"), "value", F.col("code").cast("double").alias("code")))


def apply_encoding(df: DataFrame, metadata: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numbers by the metadata: an absent column is 0, an unseen value -1, a missing number the median.

    Code tables are small next to the data (a row for each category) and are joined; Spark broadcasts them by size.
    """
    kinds = {r["column"]: (r["kind"], r["code"]) for r in metadata.groupBy("column").agg(F.first("kind").alias("kind"), F.max(F.when(F.col("kind") == "numeric", F.col("code"))).alias("code")).collect()}
    for c in columns or sorted(kinds):
        kind, median = kinds[c]
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
        elif kind == "numeric":
            df = df.withColumn(c, F.coalesce(coerce_numeric(F.col(f"`{c}`")), F.lit(median)))
        else:
            codes = metadata.where((F.col("column") == c) & (F.col("kind") == "categorical")).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            df = df.join(codes, F.col(f"`{c}`").cast("string") == F.col("_value"), "left").withColumn(c, F.coalesce("_code", F.lit(-1.0))).drop("_value", "_code")
    return df


def index_with_unknown(train: DataFrame, df: DataFrame, columns: list[str], missing: str = "__MISSING__") -> DataFrame:
    """Ids from 1 for the train categories in sorted order, 0 for unknown ones; missing text is a level of its own."""
    filled = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)) for c in columns}
    ids = _numbered(train, filled)
    for c in columns:
        one = ids.where(F.col("column") == c).select(F.col("value").alias("_value"), (F.col("code") + 1).alias("_id"))
        df = df.withColumn(c, filled[c]).join(one, F.col(f"`{c}`") == F.col("_value"), "left").withColumn(c, F.coalesce("_id", F.lit(0))).drop("_value", "_id")
    return df


def one_hot(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with an array of 0 and 1 for each column in its place, an entry for each train category in sorted order.

    Missing values are the train mode; an unseen category is all zeros. The plan doesn't grow with the categories, the arrays do:
    ``sparse_one_hot`` is for columns of very many.
    """
    ready, sizes = _coded(train, df, columns)
    for c in columns:
        ready = ready.withColumn(c, _zeros_and_one(F.col(f"_code_{c}"), sizes[c])).drop(f"_code_{c}")
    return ready


def _zeros_and_one(code: Column, size: int) -> Column:
    if not size:
        return F.array().cast("array<int>")
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce((code == i).cast("int"), F.lit(0)))


def sparse_one_hot(train: DataFrame, df: DataFrame, columns: list[str], out: str = "hot") -> tuple[DataFrame, dict[str, int]]:
    """(``df`` with a struct ``out`` of size and indices in place of the columns, the first index of each column): the places of the ones among the
    categories of all columns, so a row takes an index for each column however many categories there are."""
    ready, sizes = _coded(train, df, columns)
    first, size = {}, 0
    for c in columns:
        first[c], size = size, size + sizes[c]
    at = F.array_compact(F.array(*[F.col(f"_code_{c}") + F.lit(first[c]) for c in columns]))
    return ready.withColumn(out, F.struct(F.lit(size).alias("size"), at.cast("array<int>").alias("indices"))).drop(*columns, *[f"_code_{c}" for c in columns]), first


def _coded(train: DataFrame, df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """``df`` with missing values filled and ``_code_<column>``, null for an unseen category; and the number of categories of each column."""
    found = modes(train, columns)
    ready, codes = impute_modes(df, found), _numbered(impute_modes(train, found), {c: F.col(f"`{c}`") for c in columns})
    sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count("*").alias("n")).collect()}
    for c in columns:
        one = codes.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias(f"_code_{c}"))
        ready = ready.join(one, F.col(f"`{c}`") == F.col("_value"), "left").drop("_value")
    return ready, {c: sizes.get(c, 0) for c in columns}


def class_weights(train: DataFrame, label_col: str, scheme: str = "balanced") -> Column:
    """A weight for each row: ``balanced`` n / (k n_c), or ``pos`` n_neg / n_pos (1 without positives) on positives."""
    counts = {r["y"]: r["n"] for r in train.groupBy(F.col(f"`{label_col}`").cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    y, total = F.col(f"`{label_col}`").cast("int"), sum(counts.values())
    if scheme == "pos":
        return F.when(y == 1, F.lit(counts.get(0, 0) / counts[1] if counts.get(1) else 1.0)).otherwise(1.0)
    out = F.lit(1.0)
    for c, n in counts.items():
        out = F.when(y == c, F.lit(total / (len(counts) * n))).otherwise(out)
    return out


#: Rows that one task of a fit holds.
ROWS_OF_TASK = 50_000


@dataclass
class Prepared:
    """Fitted preparation: medians, scales, modes and the one-hot pipeline."""

    stats: dict
    modes: dict
    encoder: PipelineModel
    size: int

    def transform(self, df: DataFrame) -> DataFrame:
        return self.encoder.transform(impute_scale(impute_modes(df, self.modes), self.stats))


def prepare(train: DataFrame, label_col: str, exclude: tuple[str, ...] = ()) -> Prepared:
    """Scaled numbers and one-hot categories in ``features``; an unseen category is all zeros."""
    cat, num = column_kinds(train, (label_col, *exclude))
    stats, found = numeric_stats(train, num), modes(train, cat)
    stages: list = []
    if cat:
        index, hot = [f"_i_{c}" for c in cat], [f"_h_{c}" for c in cat]
        stages = [StringIndexer(inputCols=cat, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True)]
    stages.append(VectorAssembler(inputCols=num + [f"_h_{c}" for c in cat], outputCol="features"))
    ready = impute_scale(impute_modes(train, found), stats)
    model = Pipeline(stages=stages).fit(ready)
    first = model.transform(ready).select("features").first()
    return Prepared(stats, found, model, 0 if first is None else len(first["features"]))


def predicted(prepared: Prepared, model, df: DataFrame, label_col: str) -> DataFrame:
    """(y, prediction) of ``df``. A logistic model is scored by its coefficients in plain Columns: a number's is a factor, a
    category's a row of a small table that is joined, so an unseen category adds nothing."""
    if not isinstance(model, LogisticRegressionModel):
        return model.transform(prepared.transform(df)).select(F.col(f"`{label_col}`").alias("y"), F.col("prediction").cast("int").alias("prediction"))
    ready, weights = impute_scale(impute_modes(df, prepared.modes), prepared.stats), model.coefficients.toArray().tolist()
    score, at = F.lit(float(model.intercept)), 0
    for c in prepared.stats:
        score, at = score + F.lit(weights[at]) * F.col(f"`{c}`"), at + 1
    labels = prepared.encoder.stages[0].labelsArray if prepared.modes else []
    for c, known in zip(prepared.modes, labels, strict=True):
        rows = [(x, w) for x, w in zip(known, weights[at : at + len(known)], strict=True)]
        at += len(known)
        part = df.sparkSession.createDataFrame(rows, "_value string, _weight double")
        ready = ready.join(part, F.col(f"`{c}`") == F.col("_value"), "left").withColumn(f"_w_{c}", F.coalesce("_weight", F.lit(0.0))).drop("_value", "_weight")
        score = score + F.col(f"`_w_{c}`")
    return ready.select(F.col(f"`{label_col}`").alias("y"), (score > 0).cast("int").alias("prediction"))


RESULT = "model string, status string, error string, acc double, f1 double, sensitivity double, specificity double, tp bigint, fp bigint, tn bigint, fn bigint, n bigint, n_unexpected bigint"


def guarded(spark, name: str, scored: Callable[[], DataFrame]) -> DataFrame:
    """The result row of a model from its (y, prediction), computed when called; an error of the fit or of a prediction is a row
    with its status and text, and leaves other models' rows alone."""
    try:
        with temporary_tables():
            out = classification_metrics(scored())
            row = out.select(F.lit(name).alias("model"), F.lit("ok").alias("status"), F.lit("").alias("error"), *out.columns).first()
            return spark.createDataFrame([tuple(row)], out.select(F.lit(name).alias("model"), F.lit("ok").alias("status"), F.lit("").alias("error"), *out.columns).schema)
    except Exception as e:  # a model that can't be fitted or applied is a result of the experiment
        return spark.createDataFrame([(name, "failed", f"{type(e).__name__}: {e}"[:500], *[None] * 10)], RESULT)


def make_baseline(name: str, n_rows: int, size: int, label_col: str = "label", weight_col: str | None = None, drift: bool = False, share: float = 1.0):
    """An unfitted estimator with the reference's settings, or with those of its drift study.

    ``boosting_a`` grows trees to a depth, ``boosting_b`` best first to a number of leaves. ``share`` of the rounds of boosting are run, with steps as
    much longer, of 0.3 at most; the net and the tree always run whole.
    """
    weight = {"weightCol": weight_col} if weight_col else {}
    if name == "logistic":
        base = {"featuresCol": "features", "labelCol": label_col}
        return LogisticRegression(maxIter=2000, regParam=1 / max(n_rows, 1), elasticNetParam=0.0, standardization=False, **base, **weight)
    if name == "tree":
        return ExactTree(label_col=label_col, weight_col=weight_col)
    if name == "mlp":  # the drift study's net has no held-out part; the other has one from 100 rows on
        return Net(hidden=(64, 32), batch=64, held_out=0.0, label_col=label_col) if drift else Net(held_out=0.1 if n_rows >= 100 else 0.0, label_col=label_col)
    rounds, step, settings = BOOSTING[name, drift]
    return Boosting(rounds=max(round(rounds * share), 1), step=max(step, min(0.3, step / share)), label_col=label_col, weight_col=weight_col, **settings)


#: Rounds, step and tree settings of the two boosting baselines, and of the drift study's.
BOOSTING = {
    ("boosting_a", False): (600, 0.05, {"max_depth": 6}),
    ("boosting_b", False): (1200, 0.03, {"max_leaves": 64, "least_hessian": 1e-3, "least_rows": 20}),
    ("boosting_a", True): (200, 0.05, {"max_depth": 5}),
    ("boosting_b", True): (300, 0.05, {"max_leaves": 31, "l2": 0.0, "least_hessian": 1e-3, "least_rows": 20}),
}
#: Rounds that the drift study's second fit adds.
MORE_ROUNDS = 200


@contextmanager
def training_rows(prepared: Prepared, train: DataFrame, label_col: str, weight_col: str | None = None):
    """The prepared columns that a fit reads, kept in memory while it runs, in a task for each ROWS_OF_TASK rows.

    Boosting makes thousands of short passes, whose time on small tables is that of starting their tasks.
    """
    ready = prepared.transform(train).select("features", label_col, *([weight_col] if weight_col else [])).persist()
    try:
        yield ready.coalesce(1 + ready.count() // ROWS_OF_TASK)
    finally:
        ready.unpersist()


def fit_eval_baseline(name: str, train: DataFrame, test: DataFrame, label_col: str, weights: str | None = None, exclude: tuple[str, ...] = (), drift: bool = False, share: float = 1.0) -> DataFrame:
    """One result row (model, status, error, metrics); a failure is a row with its status and error."""

    def scored() -> DataFrame:
        kept = written(train, "baseline-train")  # each step of the preparation reads it
        n, prepared = kept.count(), prepare(kept, label_col, exclude)
        weight_col = "_weight" if weights and name != "mlp" else None
        weighted = kept.withColumn("_weight", class_weights(kept, label_col, weights)) if weight_col else kept
        made = make_baseline(name, n, prepared.size, label_col, weight_col, drift, share)
        with training_rows(prepared, weighted, label_col, weight_col) as rows:
            model = made.fit(rows)
        return predicted(prepared, model, test, label_col)

    return guarded(train.sparkSession, name, scored)


def with_prior(df: DataFrame, prepared: Prepared, model, name: str = "prior") -> DataFrame:
    """``df`` with a fitted model's prediction as a feature more."""
    scored = model.transform(prepared.transform(df.withColumns({f"_keep_{c}": F.col(f"`{c}`") for c in df.columns})))
    return scored.select(*[F.col(f"`_keep_{c}`").alias(c) for c in df.columns], F.col("prediction").cast("double").alias(name))


def two_stage_baselines(stage1: DataFrame, stage2: DataFrame, label_col: str, models: tuple[str, ...] = ("logistic", "tree", "mlp", "boosting_a", "boosting_b"), exclude: tuple[str, ...] = ("split", "row_id"), drift: bool = True, share: float = 1.0) -> DataFrame:
    """Every model fitted on stage 1 and carried to stage 2: (model, stage, status, error, metrics).

    Logistic regression is refitted (its fit is convex), the net starts from its first weights, the tree gets the first
    stage's prediction as a feature more, and boosting adds trees to those of the first stage.
    """
    train1, test1 = (stage1.where(F.col("split") == s).drop(*exclude) for s in ("train", "test"))
    train2, test2 = (stage2.where(F.col("split") == s).drop(*exclude) for s in ("train", "test"))
    rows = []
    for name in models:
        rows.append(fit_eval_baseline(name, train1, test1, label_col, drift=drift, share=share).withColumn("stage", F.lit("stage1")))
        if name == "logistic":
            second = fit_eval_baseline(name, train2, test2, label_col, drift=drift, share=share)
        elif name == "mlp":
            second = continue_mlp(train1, train2, test2, label_col, drift, share)
        elif name == "tree":
            second = continue_tree(train1, train2, test2, label_col, drift)
        else:
            second = continue_boosting(name, train1, train2, test2, label_col, drift, share)
        rows.append(second.withColumn("stage", F.lit("stage2")))
    return reduce(DataFrame.unionByName, rows)


def continue_tree(train1: DataFrame, train2: DataFrame, test2: DataFrame, label_col: str, drift: bool = False) -> DataFrame:
    """The second fit of the tree has the first one's prediction as a feature more."""
    shared = [c for c in train1.columns if c in train2.columns]

    def scored() -> DataFrame:
        first = train1.select(shared)
        n, before = first.count(), prepare(first, label_col)
        model = make_baseline("tree", n, before.size, label_col, drift=drift).fit(before.transform(first))
        train, test = (with_prior(d.select(shared), before, model) for d in (train2, test2))
        after = prepare(train, label_col)
        with training_rows(after, train, label_col) as ready:
            second = make_baseline("tree", train.count(), after.size, label_col, drift=drift).fit(ready)
        return predicted(after, second, test, label_col)

    return guarded(train1.sparkSession, "tree", scored)


def continue_boosting(name: str, train1: DataFrame, train2: DataFrame, test2: DataFrame, label_col: str, drift: bool = False, share: float = 1.0) -> DataFrame:
    """The second fit adds its rounds to the trees of the first, on the features that both stages have."""
    shared = [c for c in train1.columns if c in train2.columns]

    def scored() -> DataFrame:
        prepared = prepare(train1.select(shared), label_col)
        settings = make_baseline(name, 0, prepared.size, label_col, drift=drift, share=share)
        first = settings.fit(prepared.transform(train1.select(shared)))
        more = replace(settings, rounds=max(round(MORE_ROUNDS * share), 1), seed=settings.seed + 1)
        return predicted(prepared, more.fit(prepared.transform(train2.select(shared)), start=first), test2.select(shared), label_col)

    return guarded(train1.sparkSession, name, scored)


def continue_mlp(train1: DataFrame, train2: DataFrame, test2: DataFrame, label_col: str, drift: bool = False, share: float = 1.0) -> DataFrame:
    """The second fit of the net starts from the weights of the first, on the features that both stages have."""
    shared = [c for c in train1.columns if c in train2.columns]

    def scored() -> DataFrame:
        one, two, test = (d.select(shared) for d in (train1, train2, test2))
        prepared = prepare(one, label_col)
        first, second = (make_baseline("mlp", d.count(), prepared.size, label_col, drift=drift, share=share) for d in (one, two))
        return predicted(prepared, second.fit(prepared.transform(two), start=first.fit(prepared.transform(one))), test, label_col)

    return guarded(train1.sparkSession, "mlp", scored)
