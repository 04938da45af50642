"""Similarity graphs per group: exact and LSH candidates, mutual top-k, degree caps, node metrics, snapshot QA."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import exact_quantiles

GROUP = ["decision_time", "layer_id", "lookback_minutes"]


def _typed(df: DataFrame, group: list[str], more: str) -> T.StructType:
    own = [df.schema[c] for c in group]
    return T.StructType([*own, *T.StructType.fromDDL(more).fields])


def repeated(p: pd.DataFrame, group: list[str], n: int) -> pd.DataFrame:
    """The group's values on n rows, with their types even if n is 0."""
    return p[group].iloc[[0] * n].reset_index(drop=True)


def directed_topk(vectors: DataFrame, group: list[str], top_k: int, minimum_similarity: float, block: int = 2048) -> DataFrame:
    """(group, src_id, dst_id, similarity, rank): each node's top_k most similar others at or above the threshold.

    One group is one task, which multiplies blocks of `block` unit vectors and keeps top_k of each row; what leaves the
    task is nodes * top_k rows. Zero vectors are similar to nothing. Ties go to the smaller id.
    """

    def search(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("node_id")
        ids = p["node_id"].to_numpy(np.int64)
        x = np.array(p["vector"].tolist(), np.float64)
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12)
        parts = []
        for start in range(0, len(x), block):
            s = x[start : start + block] @ x.T
            s[np.arange(len(s)), np.arange(start, start + len(s))] = -np.inf
            s[s < minimum_similarity] = -np.inf
            order = np.argsort(-s, axis=1, kind="stable")[:, :top_k]
            sim = np.take_along_axis(s, order, 1)
            row, rank = np.nonzero(np.isfinite(sim))
            parts.append(pd.DataFrame({"src_id": ids[start + row], "dst_id": ids[order[row, rank]], "similarity": sim[row, rank], "rank": rank.astype(np.int32) + 1}))
        out = pd.concat(parts, ignore_index=True)
        return pd.concat([repeated(p, group, len(out)), out], axis=1)

    return vectors.groupBy(*group).applyInPandas(search, _typed(vectors, group, "src_id long, dst_id long, similarity double, rank int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def lsh_bits(nodes: int) -> int:
    return 10 if nodes >= 4000 else 8 if nodes >= 1000 else 6


def lsh_projection(dimension: int, bits: int) -> np.ndarray:
    """Fixed value: the generator's seed is 20260704 + dimension, and its normal numbers are 32-bit."""
    return np.random.default_rng(20260704 + dimension).standard_normal((dimension, bits), dtype=np.float32)


def lsh_codes(vectors: DataFrame, dimension: int, bits: int) -> DataFrame:
    """vectors with code: bit b is set where the projection on direction b is positive."""
    table = lsh_projection(dimension, bits)
    code = F.lit(0)
    for b in range(bits):
        direction = F.array(*(F.lit(float(v)) for v in table[:, b]))
        code = code + F.when(dot(F.col("vector"), direction) > 0, 1 << b).otherwise(0)
    return vectors.withColumn("code", code)


def lsh_topk(coded: DataFrame, group: list[str], bits: int, top_k: int, minimum_similarity: float) -> DataFrame:
    """Directed top-k among nodes of equal code, with codes one and then two bits away while fewer than top_k + 1 are found.

    How far a node must look follows from the sizes of buckets; it is then exploded to the codes it probes and meets
    its candidates in an equi-join on (group, code). The threshold applies after the top-k, as the contract has it.
    """
    sizes = coded.groupBy(*group, "code").agg(F.count(F.lit(1)).alias("n"))
    one = [1 << b for b in range(bits)]
    two = [x | y for i, x in enumerate(one) for y in one[i + 1 :]]
    codes = coded.select(*group, "code").distinct()

    def found(masks: list[int]) -> DataFrame:
        probe = codes.withColumn("mask", F.explode(F.array(*map(F.lit, masks)))).withColumn("at", F.col("code").bitwiseXOR(F.col("mask")))
        return probe.join(sizes.withColumnRenamed("code", "at"), [*group, "at"]).groupBy(*group, "code").agg(F.sum("n").alias("n"))

    own = sizes.withColumnRenamed("n", "n0")
    near = found(one).withColumnRenamed("n", "n1")
    reach = own.join(near, [*group, "code"], "left").select(*group, "code", F.when(F.col("n0") >= top_k + 1, 0).when(F.col("n0") + F.coalesce("n1", F.lit(0)) >= top_k + 1, 1).otherwise(2).alias("reach"))
    masks = F.when(F.col("reach") == 0, F.array(F.lit(0))).when(F.col("reach") == 1, F.array(*map(F.lit, [0, *one]))).otherwise(F.array(*map(F.lit, [0, *one, *two])))
    probing = coded.join(reach, [*group, "code"]).select(*group, F.col("node_id").alias("src_id"), F.col("vector").alias("_a"), F.explode(masks).alias("_m"), "code").withColumn("code", F.col("code").bitwiseXOR(F.col("_m")))
    pairs = probing.join(coded.select(*group, "code", F.col("node_id").alias("dst_id"), F.col("vector").alias("_b")), [*group, "code"]).where("src_id <> dst_id")
    norm = F.sqrt(dot(F.col("_a"), F.col("_a")) * dot(F.col("_b"), F.col("_b")))
    sim = F.when(norm > 1e-12, dot(F.col("_a"), F.col("_b")) / norm).otherwise(0.0)
    w = Window.partitionBy(*group, "src_id").orderBy(F.desc("similarity"), "dst_id")
    ranked = pairs.select(*group, "src_id", "dst_id", sim.alias("similarity")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    return ranked.where(F.col("similarity") >= minimum_similarity)


def reciprocal(directed: DataFrame, group: list[str]) -> DataFrame:
    """(group, src_id < dst_id, weight, src_rank, dst_rank) of pairs that name each other; weight is the mean."""
    one = directed.where("src_id < dst_id").withColumnsRenamed({"similarity": "_s", "rank": "src_rank"})
    two = directed.where("src_id > dst_id").select(*group, F.col("src_id").alias("dst_id"), F.col("dst_id").alias("src_id"), F.col("similarity").alias("_t"), F.col("rank").alias("dst_rank"))
    return one.join(two, [*group, "src_id", "dst_id"]).select(*group, "src_id", "dst_id", ((F.col("_s") + F.col("_t")) / 2).alias("weight"), "src_rank", "dst_rank")


def capped(edges: pd.DataFrame, cap: int) -> pd.DataFrame:
    """The edges that a pass in order of (-weight, src, dst) keeps while both ends have fewer than cap edges."""
    if cap <= 0 or edges.empty:
        return edges.iloc[:0]
    edges = edges.sort_values(["weight", "src_id", "dst_id"], ascending=[False, True, True])
    degree: dict[int, int] = {}
    keep = []
    for a, b in zip(edges["src_id"], edges["dst_id"]):
        free = degree.get(a, 0) < cap and degree.get(b, 0) < cap
        keep.append(free)
        if free:
            degree[a] = degree.get(a, 0) + 1
            degree[b] = degree.get(b, 0) + 1
    return edges[keep]


def degree_cap(edges: DataFrame, group: list[str], cap: int) -> DataFrame:
    """A strict cap on both ends. The order is sequential within a graph, so a graph is one task on its mutual edges."""
    return edges.groupBy(*group).applyInPandas(lambda p: capped(p, cap), edges.schema)


def symmetric(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group, node_id, other_id, weight), each edge from both ends."""
    ends = F.array(F.struct(F.col("src_id").alias("node_id"), F.col("dst_id").alias("other_id")), F.struct(F.col("dst_id").alias("node_id"), F.col("src_id").alias("other_id")))
    return edges.select(*group, "weight", F.explode(ends).alias("e")).select(*group, "e.node_id", "e.other_id", "weight")


def node_metrics(edges: DataFrame, nodes: DataFrame, group: list[str], graphs: DataFrame | None = None) -> DataFrame:
    """Degree and strength of every node of each group's universe, 0 for isolated ones, and the strength's z-score. graphs: the groups, if some have no edges."""
    sums = symmetric(edges, group).groupBy(*group, "node_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
    every = (edges.select(*group).distinct() if graphs is None else graphs).crossJoin(nodes)
    return with_core(every.join(sums, [*group, "node_id"], "left").fillna({"degree": 0, "strength": 0.0}), group)


def with_core(nodes: DataFrame, group: list[str]) -> DataFrame:
    """nodes with core_z, the z-score of strength within a group; 0 where it hardly varies."""
    w = Window.partitionBy(*group)
    s = F.stddev_pop("strength").over(w)
    return nodes.withColumn("core_z", F.when(s > 1e-12, (F.col("strength") - F.avg("strength").over(w)) / s).otherwise(0.0))


def neighbor_mean(edges: DataFrame, signals: DataFrame, group: list[str]) -> DataFrame:
    """sum(w * signal) / sum(w) over a node's neighbours, 0 where the weights sum to 0. signals: (node_id, signal)."""
    return neighbor_means(edges, signals, group, {"signal": "neighbor_signal"})


def neighbor_means(edges: DataFrame, signals: DataFrame, group: list[str], names: dict[str, str]) -> DataFrame:
    """The same for several signals in one pass. signals: (node_id, signals, and decision_time if they change); names: of the means."""
    on = [c for c in ("decision_time",) if c in signals.columns]
    both = symmetric(edges, group).join(signals.withColumnRenamed("node_id", "other_id"), [*on, "other_id"])
    out = both.groupBy(*group, "node_id").agg(F.sum("weight").alias("_w"), *(F.sum(F.col("weight") * F.col(c)).alias(f"_{c}") for c in names))
    return out.select(*group, "node_id", *(F.when(F.abs("_w") > 0, F.col(f"_{c}") / F.col("_w")).otherwise(0.0).alias(n) for c, n in names.items()))


def multiplex_metrics(edges: DataFrame, nodes: DataFrame, graphs: DataFrame, time: str = "decision_time") -> DataFrame:
    """(time, node) of every time of graphs (time, layer_id, ...): distinct neighbours, mean strength and share of layers with an edge over all its graphs, and core_z."""
    layers = graphs.groupBy(time).agg(F.countDistinct("layer_id").alias("_l"))
    sums = symmetric(edges, [time, "layer_id"]).groupBy(time, "node_id").agg(F.countDistinct("other_id").alias("degree"), F.sum("weight").alias("_s"), F.countDistinct("layer_id").alias("_p"))
    every = layers.crossJoin(nodes).join(sums, [time, "node_id"], "left").fillna({"degree": 0, "_s": 0.0, "_p": 0})
    out = every.select(time, "node_id", "degree", (F.col("_s") / F.col("_l")).alias("strength"), (F.col("_p") / F.col("_l")).alias("layer_participation"))
    return with_core(out, [time])


def multiplex(edges: DataFrame, time: str = "decision_time") -> DataFrame:
    """Per (time, node): distinct neighbours, mean strength and share of layers with an edge, over the time's layers."""
    both = symmetric(edges, [time, "layer_id"])
    layers = edges.groupBy(time).agg(F.countDistinct("layer_id").alias("_l"))
    out = both.groupBy(time, "node_id").agg(F.countDistinct("other_id").alias("degree"), F.sum("weight").alias("_s"), F.countDistinct("layer_id").alias("_p"))
    return out.join(layers, time).select(time, "node_id", "degree", (F.col("_s") / F.col("_l")).alias("strength"), (F.col("_p") / F.col("_l")).alias("layer_participation"))


WEIGHT_QUANTILES = {"weight_p50": 0.5, "weight_p75": 0.75, "weight_p90": 0.9, "weight_p95": 0.95, "weight_p99": 0.99}


def weight_diagnostics(edges: DataFrame, group: list[str]) -> DataFrame:
    """Quantiles of weights (linear, exact), the mean of the top ceil(1 %), and the share of weight at or above the 95 % quantile.

    The top's mean is the sum above its least weight and as many of that weight as are left, so no task orders a graph.
    """
    last = {"_least": F.col("_n") - F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.01))}
    q = exact_quantiles(edges, group, "weight", WEIGHT_QUANTILES, last, {"_least": 0.99})
    w, low = F.col("weight"), F.col("_least")
    sums = edges.join(q, group).groupBy(*group).agg(F.sum(F.when(w > low, w)).alias("_above"), F.count(F.when(w > low, w)).alias("_k"), F.sum(F.when(w >= F.col("weight_p95"), w)).alias("_tail"), F.sum("weight").alias("_whole"))
    k = F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.01))
    top = (F.coalesce("_above", F.lit(0.0)) + (k - F.col("_k")) * low) / k
    return q.join(sums, group).select(*group, *WEIGHT_QUANTILES, top.alias("top_1pct_mean_weight"), F.when(F.col("_whole") > 0, F.col("_tail") / F.col("_whole")).alias("tail_mass_95"))


def snapshot_qa(nodes: DataFrame, group: list[str], cap: int) -> DataFrame:
    """Universe, active nodes, coverage, isolation, edges, cap saturation, mean degree and strength of each group's node metrics."""
    active = (F.col("degree") > 0).cast("double")
    edges = F.sum("degree") / 2
    return nodes.groupBy(*group).agg(
        F.count(F.lit(1)).alias("universe_count"), F.sum(active).cast("long").alias("active_nodes"), F.avg(active).alias("node_coverage"), F.avg(1 - active).alias("isolated_node_ratio"), edges.cast("long").alias("edge_count"),
        (edges / F.greatest(F.lit(1.0), F.count(F.lit(1)) * cap / 2.0)).alias("degree_cap_saturation"), F.avg("degree").alias("mean_degree"), F.avg("strength").alias("mean_strength"),
    )
