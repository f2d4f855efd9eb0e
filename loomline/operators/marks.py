"""Marks on rows that are named by file and position, without moving the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: One bitmap of 4 KB tells of 32,768 rows of a file. Up to so many (64 MB) are broadcast.
MOST_BITMAPS = 16_384


def marked(rows: DataFrame, key: str, chosen: DataFrame, name: str, most: int = MOST_BITMAPS) -> DataFrame:
    """``rows`` with a boolean column ``name``: is the row's ``key`` (of ``keyed``) among those of ``chosen``?

    The chosen positions of each file are gathered to bitmaps, a bit a row, and looked up there, so rows stay where
    they were read. Where there are more than ``most`` bitmaps the keys meet in a shuffled join instead. Keys of
    ``chosen`` may repeat; a null is no key; an empty ``chosen`` marks nothing.
    """
    at = F.substring_index(F.col(key), ":", -1).cast("long") + 1
    file = F.substring_index(F.col(key), ":", 1)
    found = chosen.filter(F.col(key).isNotNull()).select(file.alias("__file"), F.bitmap_bucket_number(at).alias("__block"), F.bitmap_bit_position(at).alias("__bit"))
    bits = found.repartition("__file", "__block").groupBy("__file", "__block").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    bits = written(bits, "marks")
    if bits.limit(most + 1).count() > most:
        few = chosen.select(F.col(key)).filter(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
        return rows.join(few, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substr("__bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    met = rows.withColumns({"__file": file, "__block": F.bitmap_bucket_number(at)}).join(F.broadcast(bits), ["__file", "__block"], "left")
    return met.withColumn(name, F.coalesce(is_set, F.lit(False))).drop("__file", "__block", "__bits")


def without(rows: DataFrame, key: str, gone: DataFrame, most: int = MOST_BITMAPS) -> DataFrame:
    """``rows`` but for those whose ``key`` is in ``gone``."""
    return marked(rows, key, gone, "__gone", most).filter("not __gone").drop("__gone")
