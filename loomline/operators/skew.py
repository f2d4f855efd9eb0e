"""Joins that stay even when a few keys hold much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows, so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 400


def hot_safe_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """Join ``left`` with ``right`` (one row per key) on ``keys``.

    ``right[weight]`` is the number of left rows of the key and ``total`` bounds their sum. Keys above
    ``HOT_SHARE`` of ``total`` number fewer than ``1 / HOT_SHARE``, so broadcasting them has a fixed bound;
    the others meet in an ordinary shuffled join. ``how`` is ``left`` or ``inner``; null keys match nothing.
    The result has the columns of ``left`` and those of ``right`` but ``keys`` and ``weight``.
    """
    limit = max(1.0, total * HOT_SHARE)
    hot = right.filter(F.col(weight) > limit).drop(weight)
    cold = right.filter(F.col(weight) <= limit).drop(weight)
    few = F.broadcast(hot.select(*keys))
    return left.join(F.broadcast(hot), keys, "inner").unionByName(left.join(few, keys, "left_anti").join(cold, keys, how))
