"""Labelled tasks on the star-schema tables: (row_id, y, features), missing values made of zero discounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def returns(spark: SparkSession, sf_dir: str, multi: bool = False) -> DataFrame:
    """lineitem: was the item returned (or, with ``multi``, the flags A, N, R as 0, 1, 2)."""
    y = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "N", 1).otherwise(0) if multi else (F.col("l_returnflag") == "R").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"),
        y.alias("y"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_linestatus").alias("linestatus"),
        (F.col("l_discount") > 0.05).cast("int").alias("big_discount"),
    )


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their customers: is the order finished."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.col("o_totalprice").alias("totalprice"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
    )


def quality(spark: SparkSession, sf_dir: str, label: str = "toxic") -> DataFrame:
    """labelled documents: the imbalanced case."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("row_id"), F.col(label).alias("y"), "n_chars", "lang", "source")


def purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: is it a purchase."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        "value",
        F.get_json_object("props", "$.k").try_cast("double").alias("k"),
        F.hour("ts").alias("hour"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id") % 30).alias("group"),
    )


#: The same tasks as common table expressions, for the oracle.
SQL = {
    "returns": """returns AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id, (l_returnflag = 'R')::INT AS y,
      l_quantity AS quantity, l_extendedprice AS extendedprice, nullif(l_discount, 0.0) AS discount, l_tax AS tax,
      l_linestatus AS linestatus, (l_discount > 0.05)::INT AS big_discount,
      CASE l_returnflag WHEN 'R' THEN 2 WHEN 'N' THEN 1 ELSE 0 END AS y3 FROM lineitem)""",
    "finished": """finished AS (SELECT o_orderkey AS row_id, (o_orderstatus = 'F')::INT AS y, o_totalprice AS totalprice, c_acctbal AS acctbal,
      o_orderpriority AS priority, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "quality": """quality AS (SELECT doc_id AS row_id, toxic AS y, n_chars, lang, source FROM labels JOIN documents USING (doc_id))""",
    "purchase": """purchase AS (SELECT event_id AS row_id, (event_type = 'purchase')::INT AS y, value, TRY_CAST(props ->> '$.k' AS DOUBLE) AS k,
      hour(ts)::INT AS hour, CASE WHEN user_id % 10 <> 0 THEN user_id % 30 END AS "group" FROM events)""",
}

#: Versions of a readable rule set for ``returns``, with the same in SQL.
RULES = {
    "v0": {"triggers": [{"op": ">=", "col": "quantity", "value": 45}], "points": [{"pred": {"op": ">=", "col": "discount", "value": 0.05}, "weight": 1}, {"pred": {"op": "<=", "col": "tax", "value": 0.02}, "weight": 1}, {"pred": {"op": "=", "col": "linestatus", "value": "F"}, "weight": 1}], "cutoff": 2},
    "v1": {"triggers": [], "points": [{"pred": {"op": "=", "col": "linestatus", "value": "F"}, "weight": 2}, {"pred": {"op": "is_null", "col": "discount"}, "weight": 1}, {"pred": {"op": "<", "col": "quantity", "value": 25}, "weight": 1}], "cutoff": 3},
    "v2": {"triggers": [{"op": "and", "args": [{"op": ">", "col": "extendedprice", "value": 50000}, {"op": "or", "args": [{"op": "in", "col": "linestatus", "value": ["F"]}, {"op": "not", "args": [{"op": ">=", "col": "tax", "value": 0.04}]}]}]}], "points": [{"pred": {"op": "=", "col": "big_discount", "value": 1}, "weight": 1.5}], "cutoff": 1.5},
    "v3": {"triggers": [], "points": [{"pred": {"op": "=", "col": "linestatus", "value": "F"}, "weight": 2}, {"pred": {"op": "is_null", "col": "discount"}, "weight": 1}, {"pred": {"op": "<", "col": "quantity", "value": 25}, "weight": 1}], "cutoff": 3},
}
RULES_SQL = {
    "v0": "CASE WHEN coalesce(quantity >= 45, false) THEN 1 ELSE (coalesce(discount >= 0.05, false)::INT + coalesce(tax <= 0.02, false)::INT + coalesce(linestatus = 'F', false)::INT >= 2)::INT END",
    "v1": "(2 * coalesce(linestatus = 'F', false)::INT + (discount IS NULL)::INT + coalesce(quantity < 25, false)::INT >= 3)::INT",
    "v2": "CASE WHEN coalesce(extendedprice > 50000 AND (linestatus IN ('F') OR NOT (tax >= 0.04)), false) THEN 1 ELSE (1.5 * coalesce(big_discount = 1, false)::INT >= 1.5)::INT END",
}
RULES_SQL["v3"] = RULES_SQL["v1"]

#: The same versions as the text of Python functions.
RULES_PYTHON = {
    "v0": """
def predict_v0(features: dict) -> int:
    'Large orders, or two of three signs.'
    quantity = features.get('quantity')
    if quantity is not None and quantity >= 45:
        return 1
    points = 0
    discount = features.get('discount')
    if discount is not None:
        if discount >= 0.05:
            points += 1
    if features['tax'] <= 0.02:
        points += 1
    points += features.get('linestatus') == 'F'
    if points >= 2:
        return 1
    else:
        return 0
""",
    "v1": """
def predict_v1(features: dict) -> int:
    score = 2 if features.get('linestatus') in ('F', 'f') else 0
    quantity = features.get('quantity', 99)
    if features.get('discount') is None:
        score += 1
    if quantity < 25:
        score += 1
    elif quantity > 1000:
        score -= 0
    return int(score >= 3)
""",
}
RULES_PYTHON["v2"] = """
import math

def predict_v2(features: dict) -> int:
    tax = features.get('tax')
    dear = features.get('extendedprice') > 50000
    if dear and (features.get('linestatus') == 'F' or (tax is not None and not tax >= 0.04)):
        return 1
    weight = 1.5 * sum([features.get('big_discount') == 1])
    return 1 if 1.5 <= weight < 9 else 0
"""
RULES_PYTHON["v3"] = RULES_PYTHON["v1"].replace("predict_v1", "predict_v3")
