"""Serving: snapshots by time and the wide feature and label matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot(rows: DataFrame, time, layer_ids: list[int] | None = None, keep_multiplex: bool = False) -> DataFrame:
    """Rows of one decision time and of the given layers; node rows also keep layer 0. Both predicates reach the scan."""
    out = rows.where(F.col("decision_time") == F.lit(time))
    return out if layer_ids is None else out.where(F.col("layer_id").isin([*layer_ids, *([0] if keep_multiplex else [])]))


def graph_pivot(nodes: DataFrame, layers: dict[int, str], metrics: list[str]) -> DataFrame:
    """Wide (decision_time, symbol): graph__<layer>__<metric>, of the longest lookback that a layer has."""
    aggregates = [F.max_by(F.when(F.col("layer_id") == i, F.col(m)), F.when(F.col("layer_id") == i, F.col("lookback_minutes"))).alias(f"graph__{name}__{m}") for i, name in layers.items() for m in metrics]
    return nodes.groupBy("decision_time", "symbol").agg(*aggregates)


def unique(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows, with an error at the first key that repeats. The check is a window on the keys, so it shares the exchange of a join on them."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"repeated key of {name}: "), F.concat_ws(", ", *keys))).cast("int")).otherwise(F.col("_n"))
    return rows.withColumn("_n", n).withColumn("_n", checked).where("_n is not null").drop("_n")


def wide_matrix(features: DataFrame, labels: DataFrame, graph: DataFrame | None = None, start=None, end=None, instruments: list | None = None) -> DataFrame:
    """(datetime, instrument) with feature__ and label__ columns, bounds inclusive. Keys that repeat, in any of the three tables, raise when rows are read."""
    keys = ["decision_time", "symbol"]
    base = features
    if start is not None:
        base = base.where(F.col("decision_time") >= F.lit(start))
    if end is not None:
        base = base.where(F.col("decision_time") <= F.lit(end))
    if instruments is not None:
        base = base.where(F.col("symbol").isin(instruments))
    wanted = [c for c in labels.columns if c.startswith("label_") and not c.startswith(("label_entry", "label_exit"))]
    out = unique(base.select(*keys, *(F.col(c).alias(f"feature__{c}") for c in base.columns if c not in keys)), keys, "features")
    out = out.join(unique(labels.select(*keys, *(F.col(c).alias(f"label__{c[6:]}") for c in wanted)), keys, "labels"), keys, "left")
    if graph is not None:
        out = out.join(unique(graph.select(*keys, *(F.col(c).alias(f"feature__{c}") for c in graph.columns if c not in keys)), keys, "graph features"), keys, "left")
    return out.withColumnsRenamed({"decision_time": "datetime", "symbol": "instrument"})
