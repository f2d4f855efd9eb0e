"""Calibration of forecasts: point statistics, resampled intervals and per-bin rates as plain aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bin_index, md5_number

#: Chances of a Poisson(1) count being at most 0, 1, ... 9.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(10))
STATS = ("ece", "brier", "bss_chance", "bss_emp")


def poisson_weight(rep: Column, unit: Column) -> Column:
    """How often a replicate holds a unit: a Poisson(1) count by hash, so resampling needs no join; replicate 0 holds all once."""
    u = md5_number(F.concat_ws(":", rep.cast("string"), unit.cast("string"))) / float(1 << 32)
    n = sum(((u >= F.lit(c)).cast("int") for c in POISSON[1:]), (u >= F.lit(POISSON[0])).cast("int"))
    return F.when(rep == 0, 1).otherwise(n)


SUMS = ("n", "sp", "sy", "se", "sr")
#: Units that are weighed for all replicates at once.
UNITS = 1024


def weights(hashes: np.ndarray, reps: int) -> np.ndarray:
    """Poisson(1) counts of units (in rows, by 64-bit hashes) in replicates 1 to ``reps``; replicate 0 holds all once."""
    z = hashes.astype(np.uint64)[:, None] + np.arange(reps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ z >> np.uint64(31)) >> np.uint64(11)) * 2.0**-53
    out = np.searchsorted(np.array(POISSON), u, side="right").astype(float)
    out[:, 0] = 1.0
    return out


def _weighed(n_keys: int, reps: int):
    """Sums of a batch for all replicates: the weights of its units times its rows, by the first columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[c.to_pylist() for c in b.columns[:n_keys]], strict=True)):
                places.setdefault(key, []).append(i)
            h = b.column(n_keys).to_numpy().astype(np.int64).view(np.uint64)
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[n_keys + 1 :]])
            first, out = [at[0] for at in places.values()], []
            for at in places.values():
                total = np.zeros((reps + 1, len(SUMS)))
                for i in range(0, len(at), UNITS):
                    total += weights(h[at[i : i + UNITS]], reps).T @ rows[at[i : i + UNITS]]
                out.append(total.tolist())
            keys = [c.take(pa.array(first, pa.int64())) for c in b.columns[:n_keys]]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(out, pa.list_(pa.list_(pa.float64())))], [*b.schema.names[:n_keys], "sums"])

    return run


def resampled_bins(cells: DataFrame, by: list[str], unit: str, reps: int, bins: int = 10, md5: bool = False) -> DataFrame:
    """Per group, replicate and bin the sums that all statistics need.

    ``cells`` has ``p, y, pr`` (forecast, outcome, reference forecast) and the resampled ``unit``: all cells of a unit
    get its weight. Cells are summed by unit and bin first. A task multiplies its units' weights with their sums, so a
    row a group, bin and task is shuffled and no row is copied for a replicate; with ``md5`` the weights are those of
    ``poisson_weight``, which SQL has too, and rows are copied.
    """
    se = lambda c: F.sum(F.pow(F.col(c) - F.col("y"), F.lit(2.0)))
    rows = cells.withColumn("bin", bin_index(F.col("p"), bins)).groupBy(*by, unit, "bin")
    rows = rows.agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), se("p").alias("se"), se("pr").alias("sr"))
    if not md5:
        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*by, "bin"])
        parts = rows.select(*by, "bin", F.xxhash64(unit).alias("h"), *SUMS).mapInArrow(_weighed(len(by) + 1, reps), f"{kinds}, sums array<array<double>>")
        parts = parts.select(*by, "bin", F.posexplode("sums").alias("rep", "s"))
        return parts.groupBy(*by, "rep", "bin").agg(F.sum(F.get("s", F.lit(0))).cast("long").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(c) for i, c in enumerate(SUMS) if i])
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps)))).withColumn("w", poisson_weight(F.col("rep"), F.col(unit)))
    return rows.groupBy(*by, "rep", "bin").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in SUMS])


def statistics_of(bins: DataFrame, by: list[str]) -> DataFrame:
    """Expected calibration error, Brier score, and skill over one half and over the reference, from sums by bin."""
    s = bins.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.abs(F.col("sp") - F.col("sy"))).alias("gap"), F.sum("se").alias("se"), F.sum("sr").alias("sr"))
    n = F.when(F.col("n") > 0, F.col("n"))
    return s.select(*by, "n", (F.col("gap") / n).alias("ece"), (F.col("se") / n).alias("brier"), (1 - F.col("se") / n / 0.25).alias("bss_chance"), (1 - F.col("se") / F.when(F.col("sr") > 0, F.col("sr"))).alias("bss_emp"))


def intervals(stats: DataFrame, by: list[str], names: tuple[str, ...], level: float = 0.95) -> DataFrame:
    """Replicate 0 as the point estimate and percentiles of the others, per group."""
    tail = (1 - level) / 2
    out = []
    for c in names:
        out += [F.max(F.when(F.col("rep") == 0, F.col(c))).alias(c)]
        out += [F.percentile(F.when(F.col("rep") > 0, F.col(c)), F.lit(q)).alias(f"{c}_{n}") for n, q in (("lo", tail), ("hi", 1 - tail))]
    return stats.groupBy(*by).agg(F.max(F.when(F.col("rep") == 0, F.col("n"))).alias("n"), *out)


def calibration_intervals(cells: DataFrame, by: list[str], unit: str, reps: int = 2000, bins: int = 10, level: float = 0.95, md5: bool = False) -> DataFrame:
    return intervals(statistics_of(resampled_bins(cells, by, unit, reps, bins, md5), [*by, "rep"]), by, STATS, level)


def bin_rates(cells: DataFrame, by: list[str], unit: str, reps: int = 2000, bins: int = 10, level: float = 0.95, md5: bool = False) -> DataFrame:
    """Mean forecast and observed rate per bin, with percentile bounds of the rate over replicates that hold the bin."""
    b = resampled_bins(cells, by, unit, reps, bins, md5)
    n = F.when(F.col("n") > 0, F.col("n"))
    b = b.select(*by, "bin", "rep", "n", (F.col("sp") / n).alias("p_mean"), (F.col("sy") / n).alias("y_mean"))
    return intervals(b, [*by, "bin"], ("p_mean", "y_mean"), level)


def ece_of_means(cells: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """The same calibration error from means by bin instead of sums: a second way that must agree with the first."""
    b = cells.groupBy(*by, bin_index(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return b.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def forecast_metrics(cells: DataFrame, by: list[str], eps: float = 1e-12) -> DataFrame:
    """Log loss of forecasts kept ``eps`` off 0 and 1, accuracy at one half, observed rate and mean forecast."""
    p = F.greatest(F.least(F.col("p"), F.lit(1 - eps)), F.lit(eps))
    loss = -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    right = ((F.col("p") >= 0.5).cast("double") == F.col("y")).cast("double")
    return cells.groupBy(*by).agg(F.count("*").alias("n"), F.avg(loss).alias("log_loss"), F.avg(right).alias("accuracy"), F.avg("y").alias("rate"), F.avg("p").alias("mean_p"))
