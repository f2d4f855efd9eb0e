"""Positions and ranks without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import written


def numbered(df: DataFrame, order: list[str | Column], name: str = "i") -> DataFrame:
    """``df`` with its row number from 0 in ``order`` (which should name rows uniquely).

    Rows are dealt by range and sorted within partitions; only a count per partition meets in one place.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed, "numbered").withColumns({"__part": F.shiftright("__at", 33), "__in": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__in")).drop("__at", "__part", "__in", "__before", "__n")


def average_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, value, n, rank`` of each distinct value within ``by``: ties share their mean rank, from 1.

    Distinct values are counted first and dealt by range; within a range a running sum, before it sums of whole ranges.
    """
    keys = [*by, value]
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    placed = written(counts.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "ranks")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    inside = F.sum("n").over(W.partitionBy("__part").orderBy("__at")) - F.col("n")
    sizes = placed.groupBy("__part").agg(F.sum("n").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    run = placed.withColumn("__inside", inside).join(F.broadcast(before), "__part").withColumn("__below", F.col("__before") + F.col("__inside"))
    first = run.groupBy(*by).agg(F.min("__below").alias("__first"))
    return run.join(first, by).select(*keys, "n", (F.col("__below") - F.col("__first") + (F.col("n") + 1) / 2.0).alias("rank"))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank of ``value`` within ``by``, ties sharing their mean rank."""
    ordered = F.rank().over(W.partitionBy(*by).orderBy(value))
    return ordered + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2.0


def dealt_by_weight(df: DataFrame, order: list[str | Column], weight: str, most: int, name: str) -> DataFrame:
    """``df`` with the number of a block in column ``name``: runs of rows in ``order`` with ``weight`` up to ``most``.

    A row belongs to the block in which its weights begin, so a block holds at most ``most`` and one row more. Sums
    run within ranges of rows; before a range only sums of whole ranges.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed, "weighed").withColumn("__part", F.shiftright("__at", 33))
    sizes = placed.groupBy("__part").agg(F.sum(weight).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.sum(weight).over(W.partitionBy("__part").orderBy("__at")) - F.col(weight)
    run = placed.withColumn("__inside", inside).join(F.broadcast(before), "__part")
    return run.withColumn(name, F.floor((F.col("__before") + F.col("__inside")) / most).cast("long")).drop("__at", "__part", "__inside", "__before")


def leading(df: DataFrame, by: list[str], order: list[Column], most: int, name: str, salt: str, salts: int = 256) -> DataFrame:
    """The first ``most`` rows of each group in ``order``, numbered from 1 in column ``name``.

    A group is first cut by a hash of column ``salt`` and each part ranked for itself, so that no task sees more of a
    group than a part or the leaders of its parts.
    """
    parts = W.partitionBy(*by, "__salt").orderBy(*order)
    df = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts))).withColumn(name, F.row_number().over(parts)).filter(F.col(name) <= most)
    return df.drop("__salt", name).withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= most)
