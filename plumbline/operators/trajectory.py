"""Trajectories: pivoted windows filled and standardised per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ["decision_time", "lookback"]


def last_values(window: DataFrame, columns: list[str], group: list[str] = CELL) -> DataFrame:
    """Long (group, symbol, timestamp, feature, value): the last non-null value of each feature by availability."""
    long = window.select(*group, "symbol", "timestamp", "available_time", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x"))
    long = long.select(*group, "symbol", "timestamp", "available_time", "x.feature", F.nanvl("x.v", F.lit(None).cast("double")).alias("v")).where("v is not null")
    return long.groupBy(*group, "symbol", "timestamp", "feature").agg(F.max_by("v", "available_time").alias("value"))


def median_filled(values: DataFrame, symbols: DataFrame, group: list[str] = CELL) -> DataFrame:
    """The dense (symbol x timestamp x feature) grid of each group: missing values take the timestamp's median, else 0."""
    at = [*group, "timestamp", "feature"]
    medians = values.groupBy(*at).agg(F.median("value").alias("middle"))
    grid = medians.crossJoin(symbols)
    return grid.join(values, [*at, "symbol"], "left").select(*at, "symbol", F.coalesce("value", "middle", F.lit(0.0)).alias("value"), F.coalesce("middle", F.lit(0.0)).alias("middle"))


def standardized(filled: DataFrame, group: list[str] = CELL, value: str = "value") -> DataFrame:
    """(x - mean) / population deviation over a symbol's timestamps of one feature; 0 where the deviation is 1e-12 or less."""
    row = [*group, "symbol", "feature"]
    stats = filled.groupBy(*row).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return filled.join(stats, row).withColumn("z", F.when(F.col("_s") > 1e-12, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def residuals(filled: DataFrame) -> DataFrame:
    """Values less their timestamp's median over all symbols after filling."""
    at = [*CELL, "timestamp", "feature"]
    middle = filled.groupBy(*at).agg(F.median("value").alias("cross"))
    return filled.join(middle, at).withColumn("residual", F.col("value") - F.col("cross")).drop("cross")


def rolling_sum(values: DataFrame, frame: int, partition: list[str], order: str = "timestamp", value: str = "value") -> DataFrame:
    """The sum of the last `frame` rows of the dense grid, null unless all are present."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(1 - frame, 0)
    return values.withColumn("rolling", F.when(F.count(value).over(w) == frame, F.sum(value).over(w)))


def cross_zscore(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Population z-score within a group; nulls and NaN, and groups of deviation 1e-12 or less, give 0."""
    w = Window.partitionBy(*group)
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    s = F.stddev_pop(x).over(w)
    return rows.withColumn("z", F.coalesce(F.when(s > 1e-12, (x - F.avg(x).over(w)) / s), F.lit(0.0)))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the given order."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def vectors(standard: DataFrame, group: list[str] = CELL) -> DataFrame:
    """One array a symbol: standardised features on end, timestamps in order."""
    packed = standard.groupBy(*group, "symbol").agg(F.sort_array(F.collect_list(F.struct("feature", "timestamp", "z"))).alias("p"))
    return packed.select(*group, "symbol", F.transform("p", lambda x: x["z"]).alias("vector"))
