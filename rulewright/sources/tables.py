"""Labelled tables: loading, contract, row ids, slices (A1-A4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.sources.scratch import written


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    label_col: str


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL only: in Spark NaN is larger than every number and would trip upper thresholds."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select([F.nanvl(f"`{c}`", F.lit(None).cast("double")).cast(df.schema[c].dataType).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str | None = None) -> DataFrame:
    """A CSV with a header, or Parquet, ORC or JSON, by ``fmt`` or the path's ending. A missing path is an error.

    Give ``schema`` for CSV and JSON at scale: inferring it costs a pass over the data.
    """
    fmt = fmt or path.rstrip("/").rpartition(".")[2].lower()
    if fmt not in ("csv", "parquet", "orc", "json"):
        raise ValueError(f"unknown format: {fmt}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None).option("nanValue", "NaN")
    return nan_to_null(reader.format(fmt).load(path))


def load_dataset(spark: SparkSession, dataset: Dataset, schema: T.StructType | str | None = None) -> DataFrame:
    df = load_table(spark, dataset.path, schema)
    if dataset.label_col not in df.columns:
        raise ValueError(f"{dataset.name}: no label column {dataset.label_col}")
    return df


def feature_columns(df: DataFrame, label_col: str, id_col: str | None = None) -> list[str]:
    return [c for c in df.columns if c not in (label_col, id_col)]


def check_contract(train: DataFrame, test: DataFrame, label_col: str, id_col: str | None = None, check_values: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both tables with an INT label, after checks: the label in both, equal feature sets, labels that are whole numbers.

    Raises ValueError. The labels take one aggregation over a single column of each table.
    """
    out = []
    for name, df in (("train", train), ("test", test)):
        if label_col not in df.columns:
            raise ValueError(f"label {label_col} is missing in {name}")
    a, b = (set(feature_columns(df, label_col, id_col)) for df in (train, test))
    if a != b:
        raise ValueError(f"features differ: only in train {sorted(a - b)}, only in test {sorted(b - a)}")
    for name, df in (("train", train), ("test", test)):
        label = F.col(f"`{label_col}`")
        as_int = label.try_cast("int")
        if check_values:
            bad = df.agg(F.count_if(as_int.isNull() | (as_int.cast("double") != label.try_cast("double")))).first()[0]
            if bad:
                raise ValueError(f"{bad} labels of {name} are null or no whole numbers")
        out.append(df.withColumn(label_col, as_int))
    return out[0], out[1]


def with_row_id(df: DataFrame, order_by: list[str], id_col: str = "row_id") -> DataFrame:
    """``df`` with ids 0..n-1 in the stated order; a name that is taken is an error.

    Rows are range-sorted and written once to the shared folder; each task numbers its own rows and adds the number of rows in
    the tasks before it, so no task sees the whole table. Ties in the order get ids in no stated order. The result reads that table, which
    lives as long as the block of ``temporary_tables`` around the call.
    """
    if id_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {id_col} exists already")
    order = [F.col(f"`{c}`").asc_nulls_first() for c in order_by]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    placed = written(placed, "row-ids")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", (before - F.col("_first")).alias("_shift"))  # one row for each task
    return placed.join(offsets, "_part").select((F.col("_at") + F.col("_shift")).alias(id_col), *[F.col(f"`{c}`") for c in df.columns])


def slice_rows(df: DataFrame, id_col: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Rows with an id in [start, stop): a range predicate that reaches the scan."""
    at = F.col(f"`{id_col}`")
    return df.where((at >= start) & (at < stop) if stop is not None else at >= start)


def last_rows(df: DataFrame, id_col: str, k: int) -> DataFrame:
    """The k rows with the largest ids."""
    return df.orderBy(F.desc(f"`{id_col}`")).limit(k)
