"""Reproducible order for samples and splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed: int | Column, salt: str, id_col: str | Column) -> Column:
    """md5 of seed, salt and id: the same order whatever the partitions, in any engine that has md5."""
    key = F.col(f"`{id_col}`") if isinstance(id_col, str) else id_col
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws("|", seed.cast("string"), F.lit(salt), key.cast("string")).cast("binary"))
