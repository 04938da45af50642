"""Market-state diagnostics over edge tables (decision_time, layer_id, lookback_minutes, src_id, dst_id, weight)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from .graph import GROUP, _typed

SCALE = ["layer_id", "lookback_minutes"]
QUANTILES = (0.8, 0.9, 0.95)


def canonical(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src_id": F.least("src_id", "dst_id"), "dst_id": F.greatest("src_id", "dst_id")})


def strong_thresholds(edges: DataFrame) -> DataFrame:
    """Weight quantiles of each (layer, lookback), exact."""
    return exact_quantiles(edges, SCALE, "weight", {f"q{round(v * 100)}": v for v in QUANTILES})


def snapshot_diagnostics(edges: DataFrame, universe: int, thresholds: DataFrame) -> DataFrame:
    """Edges, active nodes, coverage, mean weight, and for each quantile the strong edges' share and their nodes' coverage.

    The weights' own quantiles and tails are graph.weight_diagnostics, the components component_metrics and the
    communities community_metrics; all share these keys.
    """
    strong = [f"q{round(v * 100)}" for v in QUANTILES]
    on = edges.join(thresholds, SCALE, "left")
    ends = on.select(*GROUP, *((F.col("weight") >= F.col(c)).alias(c) for c in strong), F.explode(F.array("src_id", "dst_id")).alias("node"))
    nodes = ends.groupBy(*GROUP, "node").agg(*(F.max(c).alias(c) for c in strong)).groupBy(*GROUP)
    nodes = nodes.agg(F.count(F.lit(1)).alias("active_nodes"), *(F.sum(F.col(c).cast("long")).alias(c) for c in strong))
    sums = on.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("edge_count"), F.avg("weight").alias("weight_mean"), *(F.avg((F.col("weight") >= F.col(c)).cast("double")).alias(f"strong_edge_ratio_{c}") for c in strong))
    coverage = F.col("active_nodes") / universe
    return sums.join(nodes, GROUP).select(*GROUP, "edge_count", "active_nodes", coverage.alias("node_coverage"), (1 - coverage).alias("isolated_node_ratio"), "weight_mean", *(f"strong_edge_ratio_{c}" for c in strong), *((F.col(c) / universe).alias(f"strong_node_coverage_{c}") for c in strong))


def temporal_diagnostics(edges: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Birth, death and persistence rates and Jaccard of a frame's pairs against those of the frame before, of all pairs and of strong ones (weight at q90 or above).

    The first frame of a (layer, lookback) has nulls. A frame without strong pairs has an empty set of them, not none.
    """
    strong = F.coalesce(F.col("weight") >= F.col("q90"), F.lit(False))
    pairs = canonical(edges.join(thresholds.select(*SCALE, "q90"), SCALE, "left")).groupBy(*GROUP, "src_id", "dst_id").agg(F.max(strong).alias("s"))
    w = Window.partitionBy(*SCALE).orderBy("decision_time")
    one = F.lit(1)
    frames = pairs.groupBy(*GROUP).agg(F.count(one).alias("all_now"), F.sum(F.col("s").cast("long")).alias("strong_now"))
    frames = frames.withColumns({"prev_time": F.lag("decision_time").over(w), "all_before": F.lag("all_now").over(w), "strong_before": F.lag("strong_now").over(w)})
    old = pairs.select(F.col("decision_time").alias("prev_time"), *SCALE, "src_id", "dst_id", F.col("s").alias("t"))
    both = pairs.join(frames.select(*GROUP, "prev_time"), GROUP).join(old, ["prev_time", *SCALE, "src_id", "dst_id"])
    kept = both.groupBy(*GROUP).agg(F.count(one).alias("all_kept"), F.sum((F.col("s") & F.col("t")).cast("long")).alias("strong_kept"))
    out, rates = frames.join(kept, GROUP, "left"), []
    for kind in ("all", "strong"):
        now, before = F.col(f"{kind}_now"), F.col(f"{kind}_before")
        stays = F.when(F.col("prev_time").isNotNull(), F.coalesce(f"{kind}_kept", F.lit(0)))
        shares = {"birth_rate": (now - stays, now), "death_rate": (before - stays, before), "persistence": (stays, before), "jaccard": (stays, now + before - stays)}
        rates += [(top / F.greatest(one, bottom)).alias(f"{kind}_{name}") for name, (top, bottom) in shares.items()]
    return out.select(*GROUP, *rates)


def resonance(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Per time: pairs that 2 or 3 layers or families hold, nodes of 5 layers or 3 families, mean layers of pairs and nodes.

    Layer 0 is left out; a layer without a family is of the family unknown. A time of layer 0 alone has zeros. layers: (layer_id, family).
    """
    named = edges.join(layers.select("layer_id", "family"), "layer_id", "left").withColumn("family", F.coalesce("family", F.lit("unknown")))
    real = canonical(named.where("layer_id <> 0"))

    def counted(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy("decision_time", *keys).agg(F.countDistinct("layer_id").alias("l"), F.countDistinct("family").alias("f"))

    many = lambda c, n, name: F.sum((F.col(c) >= n).cast("long")).alias(name)
    pairs = counted(real, "src_id", "dst_id").groupBy("decision_time").agg(
        many("l", 2, "resonant_edges_ge2_layers"), many("l", 3, "resonant_edges_ge3_layers"), many("f", 2, "resonant_edges_ge2_families"), many("f", 3, "resonant_edges_ge3_families"), F.avg("l").alias("mean_edge_layer_support")
    )
    nodes = counted(real.withColumn("node", F.explode(F.array("src_id", "dst_id"))), "node").groupBy("decision_time").agg(
        many("l", 5, "core_nodes_ge5_layers"), many("f", 3, "core_nodes_ge3_families"), F.avg("l").alias("mean_node_layer_participation")
    )
    out = edges.select("decision_time").distinct().join(pairs, "decision_time", "left").join(nodes, "decision_time", "left")
    return out.fillna(0).select("decision_time", *RESONANCE_METRICS)


#: What the daily table averages.
SNAPSHOT_METRICS = (
    "edge_count", "node_coverage", "strong_edge_ratio_q90", "strong_node_coverage_q90", "weight_p90", "weight_p95", "weight_p99", "top_1pct_mean_weight", "tail_mass_95",
    "giant_component_coverage", "community_hhi", "top_community_coverage", "weighted_modularity", "cpm_quality", "within_community_weight_ratio",
)
TEMPORAL_METRICS = ("all_birth_rate", "all_death_rate", "all_persistence", "strong_birth_rate", "strong_death_rate", "strong_persistence")
RESONANCE_METRICS = (
    "resonant_edges_ge2_layers", "resonant_edges_ge3_layers", "resonant_edges_ge2_families", "resonant_edges_ge3_families", "core_nodes_ge5_layers", "core_nodes_ge3_families", "mean_edge_layer_support", "mean_node_layer_participation",
)


def daily(snapshot: DataFrame, temporal: DataFrame, res: DataFrame, day: str = "trade_date") -> DataFrame:
    """Daily means of the metrics above that the three tables have, joined outer on the day."""
    out = None
    for table, metrics in ((snapshot, SNAPSHOT_METRICS), (temporal, TEMPORAL_METRICS), (res, RESONANCE_METRICS)):
        means = table.groupBy(day).agg(*(F.avg(c).alias(c) for c in metrics if c in table.columns))
        out = means if out is None else out.join(means, day, "full_outer")
    return out


def components_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node each is connected with)."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return nodes, nodes[label]
        label = low


def graph_components(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group, node_id, component_id): the smallest node reachable, within each group's graph."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        nodes, comp = components_of(p["src_id"].to_numpy(), p["dst_id"].to_numpy())
        return pd.DataFrame({**{c: [p[c].iloc[0]] * len(nodes) for c in group}, "node_id": nodes, "component_id": comp})

    return edges.groupBy(*group).applyInPandas(run, _typed(edges, group, "node_id long, component_id long"))


def component_metrics(members: DataFrame, group: list[str], universe: int) -> DataFrame:
    """Number of components, the largest one's coverage of the universe, and the sum of squared size shares."""
    sizes = members.groupBy(*group, "component_id").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    return sizes.groupBy(*group).agg(F.count(F.lit(1)).alias("component_count"), (F.max("n") / universe).alias("giant_component_coverage"), (F.sum(F.col("n") * F.col("n")) / (total * total)).alias("component_size_hhi"))


def community_metrics(edges: DataFrame, members: DataFrame, group: list[str], universe: int, resolution: float = 1.0) -> DataFrame:
    """Of given communities: number, sum of squared size shares, the largest one's coverage, weighted modularity, CPM quality and the share of weight within.

    Modularity: the sum over communities of within / m - (degree / 2m)^2. CPM: twice the sum of weight within less
    resolution times the possible pairs. members: (group, node_id, community_id), a row a node.
    """
    src = members.select(*group, F.col("node_id").alias("src_id"), F.col("community_id").alias("a"))
    dst = members.select(*group, F.col("node_id").alias("dst_id"), F.col("community_id").alias("b"))
    on = edges.join(src, [*group, "src_id"]).join(dst, [*group, "dst_id"])
    ends = on.select(*group, F.explode(F.array(F.struct(F.col("a").alias("c"), "weight", F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0).alias("w")), F.struct(F.col("b").alias("c"), "weight", F.lit(0.0).alias("w")))).alias("e")).select(*group, "e.*")
    per = ends.groupBy(*group, "c").agg(F.sum("weight").alias("degree"), F.sum("w").alias("within"))
    sizes = members.groupBy(*group, F.col("community_id").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    per = sizes.join(per, [*group, "c"], "left").fillna(0.0, ["degree", "within"])
    total = per.groupBy(*group).agg((F.sum("degree") / 2).alias("m"), F.sum("n").alias("nodes"))
    share, n = F.col("degree") / (2 * F.col("m")), F.col("n")
    return per.join(total, group).groupBy(*group).agg(
        F.count(F.lit(1)).alias("community_count"), F.sum(F.pow(n / F.col("nodes"), F.lit(2))).alias("community_hhi"), (F.max("n") / universe).alias("top_community_coverage"),
        F.sum(F.col("within") / F.col("m") - share * share).alias("weighted_modularity"), (2 * F.sum(F.col("within") - resolution * n * (n - 1) / 2)).alias("cpm_quality"), F.sum(F.col("within") / F.col("m")).alias("within_community_weight_ratio"),
    )


#: Metrics that reward a candidate, penalise it, and tell regimes apart.
GOOD_METRICS = ("strong_edge_ratio_q90", "strong_node_coverage_q90", "weight_p95", "weight_p99", "weighted_modularity", "within_community_weight_ratio", "strong_persistence")
BAD_METRICS = ("degree_cap_saturation", "empty_rate")
REGIME_METRICS = (
    "strong_edge_ratio_q90", "strong_node_coverage_q90", "weight_p95", "weight_p99", "tail_mass_95", "node_coverage", "community_hhi", "weighted_modularity", "within_community_weight_ratio", "strong_birth_rate", "strong_death_rate", "strong_persistence",
)
RUN = ["candidate", *SCALE]


def candidate_rows(snapshot: DataFrame, temporal: DataFrame, candidate: str, parameters: dict) -> DataFrame:
    """One candidate's diagnostics: the snapshots with their temporal rows (by day, time, layer and lookback), its parameters, empty_rate and cap saturation."""
    on = snapshot.join(temporal, ["trade_date", "decision_time", *SCALE], "left").withColumns({"candidate": F.lit(candidate), "empty_rate": (F.col("edge_count") == 0).cast("double")})
    on = on.withColumns({"top_k": F.lit(int(parameters["top_k"])), "degree_cap": F.lit(int(parameters["degree_cap"])), "minimum_similarity": F.lit(float(parameters["minimum_similarity"]))})
    if "degree_cap_saturation" in on.columns:
        return on
    nodes = F.col("universe_count") if "universe_count" in on.columns else F.lit(1.0)
    return on.withColumn("degree_cap_saturation", F.col("edge_count") / F.greatest(nodes * F.col("degree_cap") / 2.0, F.lit(1.0)))


def effect_size(rows: DataFrame, metric: str, regime: str, keys: list[str]) -> DataFrame:
    """|mean in regime - mean outside| over the sample deviation of all; regime: a boolean column, null for rows of neither side."""
    return rows.groupBy(*keys).agg(_effect(metric, F.col(regime), ~F.col(regime)).alias("effect_size"))


def _effect(metric: str, inside: Column, outside: Column) -> Column:
    spread = F.stddev_samp(metric)
    apart = F.abs(F.avg(F.when(inside, F.col(metric))) - F.avg(F.when(outside, F.col(metric))))
    return F.when(spread > 0, apart / spread)


def candidate_scores(rows: DataFrame, active: list[str], inactive: list[str], good: tuple = GOOD_METRICS, bad: tuple = BAD_METRICS, regime: tuple = REGIME_METRICS) -> DataFrame:
    """A row a (candidate, layer, lookback): means of the metrics, regime separation, their z, and multiobjective score.

    Regime separation is the mean effect size between active and inactive days over the metrics that have one, else 0;
    it is a reward like the good metrics. z is within (layer, lookback), population deviation, 1 where that is 0. The
    score is the mean reward z less 0.75 of the mean penalty z. Metrics that rows lack are left out.
    """
    good, bad = ([c for c in cs if c in rows.columns] for cs in (good, bad))
    day = F.col("trade_date").cast("string")
    effects = F.array_compact(F.array(*(_effect(c, day.isin(active), day.isin(inactive)) for c in regime if c in rows.columns)))
    mean = F.aggregate(effects, F.lit(0.0), lambda s, x: s + x) / F.size(effects)
    runs = rows.groupBy(*RUN).agg(*(F.avg(c).alias(c) for c in (*good, *bad)), F.when(F.size(effects) > 0, mean).otherwise(0.0).alias("regime_separation"))
    w = Window.partitionBy(*SCALE)

    def z(c: str) -> Column:
        s = F.stddev_pop(c).over(w)
        return (F.col(c) - F.avg(c).over(w)) / F.when(s > 0, s).otherwise(1.0)

    def mean_z(cs: list[str]) -> Column:
        some = F.array_compact(F.array(*(F.col(f"{c}_z") for c in cs)))
        return F.aggregate(some, F.lit(0.0), lambda s, x: s + x) / F.size(some) if cs else F.lit(0.0)

    reward = [*good, "regime_separation"]
    out = runs.withColumns({f"{c}_z": z(c) for c in (*reward, *bad)})
    out = out.withColumns({"reward_score": mean_z(reward), "penalty_score": mean_z(bad)})
    return out.withColumn("multiobjective_score", F.col("reward_score") - 0.75 * F.col("penalty_score"))


def best_candidates(scored: DataFrame) -> DataFrame:
    """The best of each (layer, lookback), ties by candidate."""
    w = Window.partitionBy(*SCALE).orderBy(F.desc("multiobjective_score"), "candidate")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
