"""Sliding grid: events to covering windows, normalisation, contrast and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentis.functions.events import DAY, HOUR, TOTAL, rounded

SIZE, HOP = DAY, 12 * HOUR
COUNT = -(-TOTAL // HOP)


def windows_of(t: Column, size: int = SIZE, hop: int = HOP, count: int = COUNT) -> Column:
    """Indices of the closed windows [i * hop, i * hop + size] that cover an instant."""
    low = F.greatest(F.ceil((t - size) / F.lit(float(hop)) - 1e-9), F.lit(0))
    high = F.least(F.floor(t / F.lit(float(hop)) + 1e-9), F.lit(count - 1))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def expand(rows: DataFrame, t: str = "t") -> DataFrame:
    """A row per event and covering window."""
    return rows.where(F.col(t).between(0, TOTAL)).select("*", F.explode(windows_of(F.col(t))).alias("win"))


def percentile_norm(rows: DataFrame, keys: list[str], v: str, low: float = 0.5, high: float = 0.98, least_spread: float = 10.0, most: float = 1.0) -> DataFrame:
    """Min-max between two percentiles of a signal, clamped; null stays null."""
    # A signal has at most one row per window of the grid, so a key's rows are few: one shuffle, and no join of bounds.
    own = Window.partitionBy(*keys)
    bounded = rows.withColumns({"_lo": F.percentile(v, low).over(own), "_hi": F.percentile(v, high).over(own)})
    spread = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(least_spread))
    norm = F.when(F.col(v).isNull(), None).when(spread <= 1e-12, 0.0).otherwise(F.least(F.greatest((F.col(v) - F.col("_lo")) / spread, F.lit(0.0)), F.lit(most)))
    return bounded.withColumn("norm", norm).drop("_lo", "_hi")


def local_contrast(rows: DataFrame, keys: list[str], order: str, v: str, radius: int = 5, weight: float = 0.7) -> DataFrame:
    """Weighted distance from the local and the global median."""
    near = Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius)
    everywhere = Window.partitionBy(*keys)
    return rows.withColumn("contrast", weight * (F.col(v) - F.percentile(v, 0.5).over(near)) + (1 - weight) * (F.col(v) - F.percentile(v, 0.5).over(everywhere)))


def fuse(signals: DataFrame, weights: dict[str, float], gates: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean of the signals that have a value in a window, times the gates; null redistributes its weight."""
    w = F.lit(None).cast("double")
    for name, x in weights.items():
        w = F.when(F.col("kind") == name, x).otherwise(w)
    own = signals.withColumn("w", w)
    known = F.when(F.col("norm").isNotNull(), F.col("w"))
    total = F.coalesce(F.sum(F.col("w") * F.col("norm")) / F.nullif(F.sum(known), F.lit(0.0)), F.lit(0.0))
    gate = F.coalesce(F.min(F.when(F.col("kind").isin(*gates), F.least(F.greatest("norm", F.lit(0.0)), F.lit(1.0)))), F.lit(1.0)) if gates else F.lit(1.0)
    return own.groupBy("cap", "win").agg(rounded(total * gate, 4).alias("total"))
