"""Theme forests: size-bounded splits of a layer's graph, relations between leaves, continuation over time."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _typed, repeated

CELL = ["decision_time", "layer_id", "scale"]


@dataclass(frozen=True)
class Boundary:
    """Largest leaf, smallest leaf that is not tiny, and neighbour counts tried from coarse to strong."""

    name: str
    largest: int
    tiny: int
    neighbours: tuple[int, ...] = (5, 3, 2, 1)


COARSE, FINE = Boundary("B50", 50, 10), Boundary("B35", 35, 8)


def compact_pairs(edges: DataFrame, group: list[str] = CELL) -> DataFrame:
    """(group, a < b, weight): the largest absolute weight of each unordered pair; self-loops go, null weights are 0."""
    w = F.abs(F.coalesce("weight", F.lit(0.0)))
    return edges.where("src_id <> dst_id").groupBy(*group, F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b")).agg(F.max(w).alias("weight"))


def weighted_degree(pairs: DataFrame, group: list[str] = CELL) -> DataFrame:
    ends = pairs.select(*group, "weight", F.explode(F.array("a", "b")).alias("member_id"))
    return ends.groupBy(*group, "member_id").agg(F.sum("weight").alias("degree"))


def ranked_members(members: DataFrame, degree: DataFrame, theme: list[str], group: list[str] = CELL) -> DataFrame:
    """rank_in_theme by falling degree then id, and core_score = degree over the theme's largest."""
    w = Window.partitionBy(*theme)
    on = members.join(degree, [*group, "member_id"], "left").fillna({"degree": 0.0})
    top = F.max("degree").over(w)
    return on.withColumns({"rank_in_theme": F.row_number().over(w.orderBy(F.desc("degree"), "member_id")), "core_score": F.when(top > 0, F.col("degree") / top).otherwise(0.0)})


def relation_edges(pairs: DataFrame, members: DataFrame, group: list[str] = CELL, scale: float = 0.25, hard: float = 0.25, tiers: tuple[float, float, float] = (0.60, 0.35, 0.15)) -> DataFrame:
    """Relations between leaves a < b: inter-leaf weight over the root of both internal weights (floored at 1e-12).

    strength = min(1, normalised / scale); a relation stays if it is hard or at least weak. members: (group, theme_id, member_id).
    """
    of = lambda end, name: members.select(*group, F.col("member_id").alias(end), F.col("theme_id").alias(name))
    on = pairs.join(of("a", "_s"), [*group, "a"]).join(of("b", "_t"), [*group, "b"])
    inside = on.where("_s = _t").groupBy(*group, F.col("_s").alias("theme_id")).agg(F.sum("weight").alias("w"))
    sizes = members.groupBy(*group, "theme_id").agg(F.count(F.lit(1)).alias("size"))
    across = on.where("_s <> _t").groupBy(*group, F.least("_s", "_t").alias("src_theme_id"), F.greatest("_s", "_t").alias("dst_theme_id")).agg(F.sum("weight").alias("inter_leaf_weight"), F.count(F.lit(1)).alias("edge_count"))
    for side in ("src", "dst"):
        across = across.join(inside.select(*group, F.col("theme_id").alias(f"{side}_theme_id"), F.col("w").alias(f"_{side}")), [*group, f"{side}_theme_id"], "left")
        across = across.join(sizes.select(*group, F.col("theme_id").alias(f"{side}_theme_id"), F.col("size").alias(f"{side}_size")), [*group, f"{side}_theme_id"])
    floor = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-12))
    norm = F.col("inter_leaf_weight") / F.sqrt(floor("_src") * floor("_dst"))
    out = across.withColumn("normalized_weight", norm).withColumn("relation_strength", F.least(F.lit(1.0), F.col("normalized_weight") / scale)).withColumn("hard_keep", F.col("normalized_weight") >= hard)
    s = F.col("relation_strength")
    out = out.withColumn("relation_tier", F.when(s >= tiers[0], "strong").when(s >= tiers[1], "medium").when(s >= tiers[2], "weak").otherwise("discard"))
    return out.where("hard_keep or relation_tier <> 'discard'").drop("_src", "_dst")


def leaf_stats(members: DataFrame, group: list[str]) -> DataFrame:
    sizes = members.groupBy(*group, "theme_id").agg(F.count(F.lit(1)).alias("n"))
    q = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9)))
    return sizes.groupBy(*group).agg(F.count(F.lit(1)).alias("leaf_count"), F.max("n").alias("leaf_max"), q[0].alias("leaf_median"), q[1].alias("leaf_p90"))


def continuation(members: DataFrame, key: list[str], least: float = 0.15, hard: float = 0.25) -> DataFrame:
    """Each leaf's best successor in the next frame of its key: strength = max(J, 0.7 J + 0.3 C), kept if strength >= least or J >= hard.

    Overlaps come from an equi-join of memberships on (key, next time, member), so no two leaves without a common member meet. Ties go to the smaller theme id.
    """
    times = members.select(*key, "decision_time").distinct().withColumn("dst_time", F.lead("decision_time").over(Window.partitionBy(*key).orderBy("decision_time")))
    sizes = members.groupBy(*key, "decision_time", "theme_id").agg(F.count(F.lit(1)).alias("n"))
    src = members.join(times, [*key, "decision_time"]).select(*key, F.col("decision_time").alias("src_time"), "dst_time", F.col("theme_id").alias("src_theme_id"), "member_id")
    dst = members.select(*key, F.col("decision_time").alias("dst_time"), F.col("theme_id").alias("dst_theme_id"), "member_id")
    over = src.join(dst, [*key, "dst_time", "member_id"]).groupBy(*key, "src_time", "dst_time", "src_theme_id", "dst_theme_id").agg(F.count(F.lit(1)).alias("overlap"))
    for side in ("src", "dst"):
        over = over.join(sizes.select(*key, F.col("decision_time").alias(f"{side}_time"), F.col("theme_id").alias(f"{side}_theme_id"), F.col("n").alias(f"_{side}")), [*key, f"{side}_time", f"{side}_theme_id"])
    j = F.col("overlap") / (F.col("_src") + F.col("_dst") - F.col("overlap"))
    over = over.withColumns({"jaccard": j, "containment": F.col("overlap") / F.least("_src", "_dst")}).withColumn("continuation_strength", F.greatest("jaccard", 0.7 * F.col("jaccard") + 0.3 * F.col("containment")))
    w = Window.partitionBy(*key, "src_time", "src_theme_id").orderBy(F.desc("continuation_strength"), "dst_theme_id")
    best = over.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    out = best.where((F.col("continuation_strength") >= least) | (F.col("jaccard") >= hard)).drop("_r", "_src", "_dst")
    return out.withColumns({"hard_continue": F.col("jaccard") >= hard, "fuzzy_continue": F.col("continuation_strength") >= least})


class Splitter:
    """Splits of one graph's members. near: member -> [(neighbour, weight)] by falling weight, then id."""

    def __init__(self, pairs: pd.DataFrame):
        self.weight: dict[int, dict[int, float]] = {}
        for a, b, w in zip(pairs["a"], pairs["b"], pairs["weight"]):
            if w <= 0:  # such a pair links nothing; its ends are members all the same
                continue
            self.weight.setdefault(a, {})[b] = w
            self.weight.setdefault(b, {})[a] = w
        self.near = {n: sorted(out.items(), key=lambda x: (-x[1], x[0])) for n, out in self.weight.items()}

    def components(self, members: set[int], k: int) -> list[set[int]]:
        """Components of the graph that links each member with its k heaviest neighbours inside, largest first."""
        root = {n: n for n in members}

        def find(n: int) -> int:
            while root[n] != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        for n in members:
            inside = 0
            for other, _ in self.near.get(n, ()):
                if other in root:
                    a, b = find(n), find(other)
                    root[max(a, b)] = min(a, b)
                    inside += 1
                    if inside == k:
                        break
        out: dict[int, set[int]] = {}
        for n in members:
            out.setdefault(find(n), set()).add(n)
        return sorted(out.values(), key=lambda c: (-len(c), min(c)))

    def chunks(self, members: set[int], largest: int) -> list[set[int]]:
        """Chunks of at most `largest`. Each begins at the heaviest member left (weight to all members; ties by id).

        It takes the neighbours that are left of its members, member by member in the order they came, heaviest link
        first, and, when these are used up, the heaviest members left.
        """
        degree = {n: sum(w for o, w in self.weight.get(n, {}).items() if o in members) for n in members}
        left = dict.fromkeys(sorted(members, key=lambda n: (-degree[n], n)))
        out = []

        def neighbours_of(chunk: list[int]) -> Iterator[int]:
            for n in chunk:  # the list grows while it is read
                links = ((w, degree[o], o) for o, w in self.weight.get(n, {}).items() if o in left)
                yield from (o for _, _, o in sorted(links, key=lambda x: (-x[0], -x[1], x[2])))

        while left:
            chunk = [next(iter(left))]
            del left[chunk[0]]
            for source in (neighbours_of(chunk), iter(list(left))):
                for n in source:
                    if len(chunk) == largest:
                        break
                    if n in left:
                        del left[n]
                        chunk.append(n)
            out.append(set(chunk))
        return out

    def split(self, members: set[int], bound: Boundary) -> tuple[str, int, list[set[int]]]:
        """(mode, neighbours, children): the best of the neighbour counts, forced chunks if none splits.

        Score: 2 * reduction of the largest - 0.5 * share of tiny children + 0.02 * log(1 + children).
        """
        tried = []
        for k in bound.neighbours:
            parts = self.components(members, k)
            if len(parts) > 1:
                tiny = sum(len(p) < bound.tiny for p in parts) / len(parts)
                tried.append((2 * (1 - len(parts[0]) / len(members)) - 0.5 * tiny + 0.02 * math.log1p(len(parts)), -len(tried), k, parts))
        if tried:
            _, _, k, parts = max(tried, key=lambda x: x[:2])
            return f"topk_{k}", k, parts
        return "forced_chunk", 0, self.chunks(members, bound.largest)


FOREST = "kind string, theme_id string, parent_theme_id string, level string, depth int, size int, is_leaf boolean, root_b50_theme_id string, split_mode string, topk int, child_share double, member_id long"


def build_forest(pairs: DataFrame, group: list[str] = CELL, prefix: str = "root") -> DataFrame:
    """The forest of each graph as rows of three kinds: node, edge (a node's split from its parent) and member.

    A graph's members are split until leaves have 50 or fewer (B50), then each leaf once more towards 35 (B35). Splits
    are sequential within a graph; graphs are independent tasks on compacted pairs.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        splitter, rows = Splitter(p), []
        here = [p[c].iloc[0] for c in group]

        def node(theme: str, parent: str, level: str, depth: int, members: set[int], leaf: bool, root: str, mode: str, k: int, of: int) -> None:
            rows.append((*here, "node", theme, parent, level, depth, len(members), leaf, root, None, None, None, None))
            if of:
                rows.append((*here, "edge", theme, parent, level, depth, len(members), leaf, root, mode, k, len(members) / of, None))
            if leaf:
                rows.extend((*here, "member", theme, parent, level, depth, len(members), leaf, root, None, None, None, m) for m in sorted(members))

        todo = [(prefix, "", 0, set(p["a"]) | set(p["b"]), "", 0, 0)]
        while todo:
            theme, parent, depth, members, mode, k, of = todo.pop()
            leaf = len(members) <= COARSE.largest
            node(theme, parent, COARSE.name, depth, members, leaf, theme if leaf else "", mode, k, of)
            if not leaf:
                mode, k, children = splitter.split(members, COARSE)
                todo += [(f"{theme}.b50_{n:03d}", theme, depth + 1, c, mode, k, len(members)) for n, c in enumerate(children)]
                continue
            mode, k, children = splitter.split(members, FINE) if len(members) > FINE.largest else ("passthrough", 0, [members])
            for n, c in enumerate(children):
                node(f"{theme}.b35_{n:03d}", theme, FINE.name, depth + 1, c, True, theme, mode, k, len(members))
        return pd.DataFrame(rows, columns=[*group, *(x.split()[0] for x in FOREST.split(", "))])

    return pairs.groupBy(*group).applyInPandas(run, _typed(pairs, group, FOREST))


def structural_forest(themes: DataFrame, units: DataFrame, least: int = 5, most: int = 160, ratio: float = 0.85, duplicate: float = 0.72, children: int = 12, least_root: int = 20) -> DataFrame:
    """(snapshot_time, theme_instance_id, child, members, layers): a theme's diverse structural children.

    A child is the part of a theme that a unit community (least..most members) holds, of least members and at most
    ratio of the theme. Candidates are ranked by layers that support them, size, then members; one too similar to a chosen
    one is passed over. Themes that are too small or have fewer than two children are not split. Intersections are made by
    a join on members; the choice among a theme's candidates is sequential, a task a theme.
    themes: (snapshot_time, theme_instance_id, members); units: (snapshot_time, layer_name, members).
    """
    fit = units.where(F.size("members").between(least, most)).select("snapshot_time", "layer_name", F.xxhash64("layer_name", "members").alias("unit"), F.explode("members").alias("m"))
    roots = themes.where(F.size("members") >= least_root).select("snapshot_time", "theme_instance_id", F.size("members").alias("root_size"), F.explode("members").alias("m"))
    parts = roots.join(fit, ["snapshot_time", "m"]).groupBy("snapshot_time", "theme_instance_id", "root_size", "layer_name", "unit").agg(F.sort_array(F.collect_set("m")).alias("members"))
    parts = parts.where((F.size("members") >= least) & (F.size("members") <= F.least(F.lit(most), F.floor(F.col("root_size") * ratio))))
    parts = parts.groupBy("snapshot_time", "theme_instance_id", "root_size", "members").agg(F.sort_array(F.collect_set("layer_name")).alias("layers"))

    def choose(p: pd.DataFrame) -> pd.DataFrame:
        ranked = sorted(zip(p["members"], p["layers"]), key=lambda x: (-len(x[1]), -len(x[0]), tuple(x[0])))
        chosen: list[tuple[set, list]] = []
        for members, layers in ranked:
            m = set(members)
            if len(chosen) < children and all(len(m & o) / len(m | o) <= duplicate for o, _ in chosen):
                chosen.append((m, list(layers)))
        chosen = chosen if len(chosen) >= 2 else []
        return repeated(p, ["snapshot_time", "theme_instance_id"], len(chosen)).assign(
            child=np.arange(1, len(chosen) + 1, dtype=np.int32), members=pd.Series([sorted(m) for m, _ in chosen], dtype=object), layers=pd.Series([x for _, x in chosen], dtype=object)
        )

    return parts.groupBy("snapshot_time", "theme_instance_id").applyInPandas(choose, _typed(parts, ["snapshot_time", "theme_instance_id"], "child int, members array<long>, layers array<string>"))
