"""First k rows per group and overall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(
    frame: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1
) -> DataFrame:
    """The first ``k`` rows of each group in ``order``.

    The filter on the row number lets Spark keep only k rows per group in every task before
    the shuffle, so a group's size does not matter.
    """
    ranked = frame.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def top_k(frame: DataFrame, order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows overall; end ``order`` with the keys to make ties repeatable."""
    return frame.orderBy(*order).limit(k)
