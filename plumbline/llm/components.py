"""Connected components: of an edge table by star contraction on stored tables, and of arrays in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import forget, ship, stored

#: So many links at most are connected by one task, in memory; more take rounds of exchanges.
ALONE = 100_000


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node points at one root that points nowhere: (hi, lo) distinct, hi > lo."""
    roots = edges.select(F.col("lo").alias("hi")).distinct()
    return edges.groupBy("hi").count().where("count > 1").isEmpty() and edges.join(roots, "hi", "left_semi").isEmpty()


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(hi, lo) of the nodes of all batches' links that are not their component's smallest node lo."""
    links = [x for x in batches if len(x)]
    if links:
        code, names = pd.factorize(pd.concat([x[end] for end in ("hi", "lo") for x in links], ignore_index=True), sort=True)
        root = connected(len(names), *np.split(code, 2))
        moved = np.flatnonzero(root != np.arange(len(names)))
        yield pd.DataFrame({"hi": names[moved], "lo": names[root[moved]]})


def components(links: DataFrame, alone: int = ALONE) -> DataFrame:
    """(node, component) of the nodes of links (a, b) that are not their component's smallest node.

    Links are counted first. Up to `alone` of them meet in one task. For more there are alternating large-star and
    small-star rounds, a number that grows with the logarithm of the longest path. Each round's tables are written to the
    shared folder, so that a lost executor costs no earlier round and joins against a hub's single row can be split.
    Nothing but counts comes to the driver.
    """
    spark = links.sparkSession
    pairs, pairs_path = stored(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")), "links")
    if pairs.count() <= alone:
        ship(spark)
        edges, _ = stored(pairs.coalesce(1).mapInPandas(_stars, pairs.schema), "stars")
        forget(spark, pairs_path)
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    edges, path = stored(pairs.distinct(), "links")
    forget(spark, pairs_path)
    while not _is_stars(edges):
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least, least_path = stored(both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("m")), "least")
        large, large_path = stored(both.join(least, "hi").where("lo > hi and lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct(), "large-star")
        least2, least2_path = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        moved = large.join(least2, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small, small_path = stored(least2.select("hi", F.col("m").alias("lo")).unionByName(moved).distinct(), "small-star")
        forget(spark, path, least_path, large_path, least2_path)
        edges, path = small, small_path
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that edges a-b connect with each of n."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    while (label[label] != label).any():
        label = label[label]
    return label
