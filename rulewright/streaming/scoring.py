"""Rules over streams: a compiled rule set is stateless, so the batch Column scores a stream as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.operators.metrics import confusion_counts
from rulewright.operators.rules import score_rules


def score_stream(stream: DataFrame, rules: dict | str, out: str = "prediction") -> DataFrame:
    return score_rules(stream, rules, out)


def windowed_confusion(stream: DataFrame, rules: dict | str, ts_col: str, y_col: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Confusion counts of a rule set for each event-time window; rows later than ``late`` are left out by the watermark."""
    scored = score_rules(stream, rules).withColumn("y", F.col(f"`{y_col}`"))
    scored = scored.withWatermark(ts_col, late) if stream.isStreaming else scored
    return scored.groupBy(F.window(ts_col, window).alias("w")).agg(*confusion_counts()).select(F.col("w.start").alias("start"), "tp", "tn", "fp", "fn")
