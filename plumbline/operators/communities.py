"""Communities per graph, their hierarchy, consensus themes and theme lifecycles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .graph import _typed, repeated


def moved_communities(a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 0, passes: int = 20, outside: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, community) of a weighted graph: local moves by modularity gain, contraction, and a refinement of the nodes.

    Nodes move in an order drawn from seed until none gains, communities become nodes, and so on; at the end communities
    are split where they are not connected and single nodes move again, until neither happens. Communities are numbered
    by their smallest node. outside: the weight of edges of the graph that are not given, as they touch none of these nodes.
    """
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = where[: len(a)].tolist(), where[len(a) :].tolist()
    n = len(nodes)
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for x, y, v in zip(i, j, w.tolist()):
        links[x][y] = links[x].get(y, 0.0) + v
        if x != y:
            links[y][x] = links[y].get(x, 0.0) + v
    base = [dict(d) for d in links]
    loops, member, total = [0.0] * n, list(range(n)), 2 * (float(w.sum()) + outside) or 1.0
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        m = len(links)
        degree = [sum(d.values()) + 2 * loops[k] for k, d in enumerate(links)]
        of, weight, moved = list(range(m)), degree.copy(), False
        for _ in range(passes):
            changed = False
            for k in rng.permutation(m).tolist():
                gain: dict[int, float] = {}
                for o, v in links[k].items():
                    gain[of[o]] = gain.get(of[o], 0.0) + v
                own = of[k]
                weight[own] -= degree[k]
                score = lambda c: gain.get(c, 0.0) - resolution * degree[k] * weight[c] / total  # noqa: B023, E731
                best = max([*gain, own], key=lambda c: (score(c), c == own, -c))
                if score(best) > score(own) + 1e-12:
                    of[k], changed, moved = best, True, True
                weight[of[k]] += degree[k]
            if not changed:
                break
        if not moved:
            break
        names = {c: x for x, c in enumerate(sorted(set(of)))}
        fresh: list[dict[int, float]] = [{} for _ in names]
        new_loops = [0.0] * len(names)
        for k, d in enumerate(links):
            x = names[of[k]]
            new_loops[x] += loops[k]
            for o, v in d.items():
                y = names[of[o]]
                if x == y:
                    new_loops[x] += v / 2
                else:
                    fresh[x][y] = fresh[x].get(y, 0.0) + v
        member = [names[of[k]] for k in member]
        links, loops = fresh, new_loops
    return nodes, settled(base, np.array(member), resolution / total)


def modularity(a: np.ndarray, b: np.ndarray, w: np.ndarray, community: dict[int, int], resolution: float = 1.0) -> float:
    """Weighted modularity of a partition of the nodes."""
    total, inside, degree = 2 * float(w.sum()), 0.0, {}
    for x, y, v in zip(a.tolist(), b.tolist(), w.tolist()):
        inside += 2 * v * (community[x] == community[y])
        for n in (x, y):
            degree[community[n]] = degree.get(community[n], 0.0) + v
    return inside / total - resolution * sum(d * d for d in degree.values()) / total**2 if total else 0.0


def settled(links: list[dict[int, float]], of: np.ndarray, pull: float) -> np.ndarray:
    """The partition `of`, refined until every community is connected and no node gains by leaving or by joining a neighbour's.

    pull: resolution over twice the graph's weight. Communities are numbered by their smallest node.
    """
    degree = [sum(d.values()) + d.get(k, 0.0) for k, d in enumerate(links)]
    of, changed = of.tolist(), True
    while changed:
        part, stack = [-1] * len(links), []
        for k in range(len(links)):
            if part[k] < 0:
                part[k], stack = k, [k]
                while stack:
                    x = stack.pop()
                    for o in links[x]:
                        if part[o] < 0 and of[o] == of[x]:
                            part[o] = k
                            stack.append(o)
        of, changed, weight = part, False, [0.0] * len(links)
        for k, c in enumerate(of):
            weight[c] += degree[k]
        moved = True
        while moved:
            moved = False
            for k in range(len(links)):
                near: dict[int, float] = {}
                for o, v in links[k].items():
                    if o != k:
                        near[of[o]] = near.get(of[o], 0.0) + v
                own, rest = of[k], weight[of[k]] - degree[k]
                value = {c: v - pull * degree[k] * (rest if c == own else weight[c]) for c, v in near.items()}
                value.setdefault(own, -pull * degree[k] * rest)
                if min(value.values()) < 0 and rest:
                    empty = next((c for c, x in enumerate(weight) if not x and c not in near), None)
                    if empty is not None:
                        value[empty] = 0.0
                best = max(value, key=lambda c: (value[c], c == own, -c))
                if value[best] > value[own] + 1e-12:
                    weight[own] -= degree[k]
                    weight[best] += degree[k]
                    of[k], moved, changed = best, True, True
    return np.unique(of, return_inverse=True)[1] if links else np.zeros(0, int)


def detect(edges: DataFrame, group: list[str], resolution: float = 1.0, seed: int = 0, least: int = 3, universe: int | None = None, market_share: float = 0.15, child_resolution: float = 1.4, least_parent: int = 30, outside: str | None = None) -> DataFrame:
    """Communities of each graph and their parts: (group, community_id, parent_id, members, is_market_mode, modularity).

    modularity is that of the graph's whole partition into communities, small ones too. Communities of `least` members or more; those above market_share of the universe are market mode. Inside a
    community of least_parent members or more, a run at child_resolution gives parts, numbered on, never market mode.
    outside: a column, one value a graph, of the weight of edges left out that touch none of its nodes; modularity then
    counts the given edges alone.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a, b, w = p["src_id"].to_numpy(np.int64), p["dst_id"].to_numpy(np.int64), p["weight"].to_numpy(float)
        size = universe or len(np.unique(np.concatenate([a, b])))
        nodes, of = moved_communities(a, b, w, resolution, seed, outside=float(p[outside].iloc[0]) if outside else 0.0)
        quality = modularity(a, b, w, dict(zip(nodes.tolist(), of.tolist())), resolution)
        found = [(None, m, len(m) > market_share * size) for m in (nodes[of == c] for c in range(of.max() + 1 if len(of) else 0)) if len(m) >= least]
        for parent, (_, m, _) in enumerate(list(found)):
            if len(m) >= least_parent:
                inside = np.isin(a, m) & np.isin(b, m)
                kids, kid_of = moved_communities(a[inside], b[inside], w[inside], child_resolution, seed + parent + 1)
                parts = [kids[kid_of == c] for c in range(kid_of.max() + 1 if len(kid_of) else 0)]
                found += [(parent, x, False) for x in parts if least <= len(x) < len(m)]
        return repeated(p, group, len(found)).assign(
            community_id=np.arange(len(found), dtype=np.int32), parent_id=pd.array([x for x, _, _ in found], "Int32"), members=pd.Series([m.tolist() for _, m, _ in found], dtype=object), is_market_mode=np.array([bool(k) for _, _, k in found], bool), modularity=np.full(len(found), quality)
        )

    return edges.groupBy(*group).applyInPandas(run, _typed(edges, group, "community_id int, parent_id int, members array<long>, is_market_mode boolean, modularity double"))


def bare_layer(name):
    """A layer's name without the scale that a production run appends (layer@15m)."""
    return F.regexp_replace(name, "@[0-9]+m$", "")


#: Layers that never vote.
DISABLED = ("return_corr", "return_corr_cross_sectional_residual")


#: Members of a class that meet another class's in one row.
SLICE = 256


def class_scores(communities: DataFrame, weights: dict[str, float] | None = None, excluded: tuple[str, ...] = DISABLED) -> tuple[DataFrame, DataFrame]:
    """Classes (snapshot_time, class, units, n, members), and (snapshot_time, a <= b, score, layers) of every two that a community holds.

    A class is the n members of the very same communities (units), named by its smallest; all pairs between two classes, or
    inside one (a = b, of two members or more), score alike. score: the summed layer weights (default 1) of communities, not market
    mode, that hold both; layers: theirs. Market mode and excluded layers go first.
    """
    bare = bare_layer(F.col("layer_name"))
    weight = F.lit(1.0)
    for name, v in (weights or {}).items():
        weight = F.when(bare == name, float(v)).otherwise(weight)
    use = communities.where(~F.col("is_market_mode") & ~bare.isin(*excluded)).select("snapshot_time", bare.alias("layer"), weight.alias("w"), F.array_distinct("members").alias("members")).where("w > 0")
    units = kept(use.withColumn("unit", F.monotonically_increasing_id()), "units")
    alike = units.select("snapshot_time", "unit", F.explode("members").alias("m")).groupBy("snapshot_time", "m").agg(F.array_sort(F.collect_list("unit")).alias("units"))
    classes = alike.groupBy("snapshot_time", "units").agg(F.array_sort(F.collect_list("m")).alias("members"))
    classes = kept(classes.select("snapshot_time", F.col("members")[0].alias("class"), "units", F.size("members").cast("long").alias("n"), "members"), "classes")
    held = classes.select("snapshot_time", F.col("class").alias("m"), (F.col("n") > 1).alias("several"), F.explode("units").alias("unit"))
    some = held.join(units.select("unit", "layer", "w"), "unit").groupBy("snapshot_time", "unit", "layer", "w").agg(F.array_sort(F.collect_list(F.struct("m", "several"))).alias("of"))
    pairs = some.select("snapshot_time", "layer", "w", F.posexplode("of").alias("i", "x"), "of")
    pairs = pairs.select("snapshot_time", "layer", "w", F.col("x.m").alias("a"), F.explode(F.slice("of.m", F.col("i") + F.when(F.col("x.several"), 1).otherwise(2), F.size("of"))).alias("b"))
    return classes, pairs.groupBy("snapshot_time", "a", "b").agg(F.sum("w").alias("score"), F.collect_set("layer").alias("layers"))


def member_pairs(scores: DataFrame, classes: DataFrame) -> DataFrame:
    """scores with all pairs a < b of members in place of pairs of classes; SLICE members of a class with all of the other are a row till then."""
    more = [c for c in scores.columns if c not in ("snapshot_time", "a", "b")]
    one, two = (classes.select("snapshot_time", F.col("class").alias(c), F.col("members").alias(f"_{c}")) for c in "ab")
    both = scores.join(one, ["snapshot_time", "a"]).join(two, ["snapshot_time", "b"])
    cut = both.withColumn("_s", F.explode(F.sequence(F.lit(0), F.floor((F.size("_a") - 1) / SLICE).cast("int"))))
    cut = cut.withColumn("_a", F.slice("_a", F.col("_s") * SLICE + 1, SLICE))
    # rows say little about the pairs that they give, so AQE must not join their partitions
    dealt = cut.repartition(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), "snapshot_time", "a", "b", "_s")
    first = dealt.select("snapshot_time", *more, (F.col("a") == F.col("b")).alias("_same"), "_s", "_b", F.posexplode("_a").alias("_i", "_x"))
    rest = F.when(F.col("_same"), F.slice("_b", F.col("_s") * SLICE + F.col("_i") + 2, F.size("_b"))).otherwise(F.col("_b"))
    ends = first.select("snapshot_time", *more, "_x", F.explode(rest).alias("_y"))
    return ends.select("snapshot_time", F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), *more)


def pair_scores(communities: DataFrame, weights: dict[str, float] | None = None, excluded: tuple[str, ...] = DISABLED, least: float = 0.35) -> DataFrame:
    """(snapshot_time, a < b, score, layers) of all members' pairs that score `least`, as class_scores has it.

    Only such pairs are made: classes are compared first.
    """
    classes, scores = class_scores(communities, weights, excluded)
    return member_pairs(scores.where(F.col("score") >= least), classes)


def consensus_themes(communities: DataFrame, families: dict[str, str], least: float = 0.35, least_families: int = 2, least_members: int = 3, seed: int = 0, universe: int | None = None, market_share: float = 0.15, run: str = "run", **scoring) -> DataFrame:
    """Themes of each snapshot: communities of the graph of pairs that score `least`, which layers of least_families families support.

    consensus_score is the mean over all scored pairs inside, those below the threshold too; structure = min(1, score *
    (0.6 + 0.4 * min(1, 8 / n))). Layers support a theme that hold a pair inside it. The instance's id is the time and the
    first ten digits of the SHA-1 of the members, the path's the run and the theme's number in the snapshot. With a
    universe, size_share is the members over it, and themes above market_share are market mode. Classes of members that the
    same communities hold stand for their pairs. A class whose pairs score `least`, and that is linked with no other, is a
    component of equal weights, which moves always make one community; only the other classes' pairs are made, and where there
    are none, members are told apart nowhere. Classes, scores and communities are made at the call and kept (session.kept).
    """
    classes, scores = class_scores(communities, **scoring)
    scores = kept(scores, "class-scores")
    strong = scores.where(F.col("score") >= least)
    share = market_share if universe else 2.0
    linked = strong.where("a <> b").select("snapshot_time", F.explode(F.array("a", "b")).alias("class")).distinct()
    some = not strong.where("a <> b").isEmpty()  # else no plan is made of members
    alone = strong.where("a = b").select("snapshot_time", F.col("a").alias("class"), "score")
    alone = alone.join(linked, ["snapshot_time", "class"], "left_anti") if some else alone
    whole = classes.join(alone, ["snapshot_time", "class"])
    found = whole.where(F.col("n") >= least_members).select("snapshot_time", "members", (F.col("n") > (F.lit(share * universe) if universe else F.col("n"))).alias("is_market_mode"), "class")
    if some:
        outside = whole.groupBy("snapshot_time").agg(F.sum(F.col("score") * F.col("n") * (F.col("n") - 1) / 2).alias("outside"))
        graph = member_pairs(strong.join(linked.withColumnRenamed("class", "a"), ["snapshot_time", "a"], "left_semi").select("snapshot_time", "a", "b", F.col("score").alias("weight")), classes)
        graph = graph.withColumnsRenamed({"a": "src_id", "b": "dst_id"}).join(outside, "snapshot_time", "left").fillna(0.0, ["outside"])
        moved = detect(graph, ["snapshot_time"], seed=seed, least=least_members, universe=universe, market_share=share, least_parent=1 << 30, outside="outside")
        found = moved.select("snapshot_time", F.array_sort("members").alias("members"), "is_market_mode", F.lit(None).cast(classes.schema["class"].dataType).alias("class")).unionByName(found)
    found = kept(found.withColumn("theme", (F.row_number().over(Window.partitionBy("snapshot_time").orderBy(F.col("members")[0])) - 1).cast("int")), "found-themes")
    inside = found.where("class is not null").select("snapshot_time", "theme", "class", F.size("members").cast("long").alias("n"))
    if some:
        parts = classes.join(linked, ["snapshot_time", "class"], "left_semi").select("snapshot_time", "class", F.explode("members").alias("m"))
        mixed = found.where("class is null").select("snapshot_time", "theme", F.explode("members").alias("m")).join(parts, ["snapshot_time", "m"])
        inside = inside.unionByName(mixed.groupBy("snapshot_time", "theme", "class").agg(F.count(F.lit(1)).alias("n")))
    ends = scores.join(inside.toDF("snapshot_time", "ta", "a", "na"), ["snapshot_time", "a"]).join(inside.toDF("snapshot_time", "tb", "b", "nb"), ["snapshot_time", "b"]).where("ta = tb")
    ends = ends.withColumn("pairs", F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))).where("pairs > 0")
    family = F.create_map(*(F.lit(x) for kv in families.items() for x in kv))
    mean = ends.groupBy("snapshot_time", F.col("ta").alias("theme")).agg((F.sum(F.col("score") * F.col("pairs")) / F.sum("pairs")).alias("consensus_score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("layers")))).alias("source_layers"))
    mean = mean.withColumn("source_families", F.array_sort(F.array_distinct(F.transform("source_layers", lambda x: F.coalesce(family[x], x)))))
    out = found.join(mean, ["snapshot_time", "theme"]).where(F.size("source_families") >= least_families)
    n = F.size("members")
    out = out.withColumn("structure_score", F.least(F.lit(1.0), F.col("consensus_score") * (0.6 + 0.4 * F.least(F.lit(1.0), 8 / n))))
    if universe:
        out = out.withColumn("size_share", n / universe)
    digest = F.substring(F.sha1(F.array_join(F.transform("members", lambda m: m.cast("string")), ",").cast("binary")), 1, 10)
    ids = {"theme_instance_id": F.concat_ws("_", F.date_format("snapshot_time", "yyyyMMdd'T'HHmmss"), digest), "theme_path_id": F.concat(F.lit(f"{run}_new_"), F.lpad((F.col("theme") + 1).cast("string"), 4, "0"))}
    return out.withColumns(ids).drop("theme", "class")


LIFE = "snapshot_time timestamp, theme_instance_id string, theme_path_id string, event_type string, status string, age_frames int, duration_minutes int, overlap double, previous_instance_id string"


def overlaps(themes: DataFrame, least: float, run: str) -> DataFrame:
    """(run, snapshot_time, theme_instance_id, before, previous, overlap): the themes of the frame before, at the time before, whose overlap is least or more.

    Overlap is common members over the smaller size, counted by a join on members, so that only themes that share one meet.
    """
    times = themes.select(run, "snapshot_time").distinct()
    steps = times.withColumn("next", F.lead("snapshot_time").over(Window.partitionBy(run).orderBy("snapshot_time"))).where("next is not null")
    now = themes.select(run, "snapshot_time", "theme_instance_id", F.size("members").alias("n"), F.explode("members").alias("m"))
    old = themes.join(steps, [run, "snapshot_time"]).select(run, F.col("next").alias("snapshot_time"), F.col("snapshot_time").alias("before"), F.col("theme_instance_id").alias("previous"), F.size("members").alias("o"), F.explode("members").alias("m"))
    common = now.join(old, [run, "snapshot_time", "m"]).groupBy(run, "snapshot_time", "theme_instance_id", "n", "before", "previous", "o").agg(F.count(F.lit(1)).alias("c"))
    return common.select(run, "snapshot_time", "theme_instance_id", "before", "previous", (F.col("c") / F.least("n", "o")).alias("overlap")).where(F.col("overlap") >= least)


def lifecycle(themes: DataFrame, frame_minutes: int, least: float = 0.5, run: str | None = None) -> DataFrame:
    """Birth, continuation, merge, split and death of themes from frame to frame.

    A theme's matches are the frame before's themes whose overlap (common members over the smaller size) is least or
    more, best first, ties by id. The first theme, in order of ids, to claim its best match carries on its path (merge if it
    has several matches); a later claimant is a split. A theme of the frame before that none overlaps dies. Matches are
    joined, and summed up to a row a theme: its best match, how many it has, and whether the next frame matches it. Claims,
    deaths and paths, a name and an age handed along claimed matches, are followed in order, a task a run, on these rows of
    two ids. Themes are made at the call and kept (session.kept). run: a column that separates independent runs.
    """
    key = run or "_run"
    rows = (themes if run else themes.withColumn("_run", F.lit(0))).select(key, F.col("snapshot_time").cast("timestamp").alias("snapshot_time"), "theme_instance_id", F.array_distinct("members").alias("members"))
    rows = kept(rows.where(F.col(key).isNotNull() & F.col("snapshot_time").isNotNull()), "lifecycle-themes")
    match = F.struct((-F.col("overlap")).alias("less"), F.col("previous"))  # the least is the best
    none = F.lit(None).cast("struct<less: double, previous: string>")
    ends = F.array(F.struct("snapshot_time", "theme_instance_id", match.alias("match"), F.lit(False).alias("seen")), F.struct(F.col("before").alias("snapshot_time"), F.col("previous").alias("theme_instance_id"), none.alias("match"), F.lit(True).alias("seen")))
    told = overlaps(rows, least, key).select(key, F.inline(ends)).unionByName(rows.select(key, "snapshot_time", "theme_instance_id", none.alias("match"), F.lit(False).alias("seen")))
    told = told.groupBy(key, "snapshot_time", "theme_instance_id").agg(F.min("match").alias("best"), F.count("match").alias("matches"), F.max("seen").alias("seen"))
    told = told.select(key, F.unix_micros("snapshot_time").alias("at"), "theme_instance_id", (-F.col("best.less")).alias("overlap"), F.col("best.previous").alias("previous"), "matches", "seen")

    def follow(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        before: dict[str, tuple[str, int]] = {}  # the paths of the frame before, and its themes that none overlaps
        dying: list[str] = []
        for at, frame in p.sort_values(["at", "theme_instance_id"]).groupby("at"):
            paths, claimed = {}, set()
            for name, overlap, previous, matches in zip(frame["theme_instance_id"], frame["overlap"], frame["previous"], frame["matches"]):
                if matches and previous not in claimed:
                    claimed.add(previous)
                    path, age = before[previous]
                    paths[name] = (path, age + 1)
                    out.append((at, name, path, "merge" if matches > 1 else "continuation", "active", age + 1, overlap, previous))
                else:
                    paths[name] = (name, 1)
                    out.append((at, name, name, "split" if matches else "birth", "active", 1, overlap if matches else 1.0, previous if matches else None))
            out += [(at, name, before[name][0], "death", "inactive", before[name][1], 0.0, name) for name in dying]
            before, dying = paths, frame["theme_instance_id"][~frame["seen"]].tolist()
        named = pd.DataFrame(out, columns=columns)
        return named.assign(duration_minutes=named["age_frames"] * frame_minutes).astype({"age_frames": np.int32, "duration_minutes": np.int32})[columns + ["duration_minutes"]]

    columns = ["at", "theme_instance_id", "theme_path_id", "event_type", "status", "age_frames", "overlap", "previous_instance_id"]
    followed = told.groupBy(key).applyInPandas(follow, LIFE.replace("snapshot_time timestamp", "at long"))
    return followed.select(F.timestamp_micros("at").alias("snapshot_time"), *(x.split()[0] for x in LIFE.split(", ")[1:]))


def latest_per_path(events: DataFrame, path: str = "theme_path_id", time: str = "snapshot_time") -> DataFrame:
    w = Window.partitionBy(path).orderBy(F.desc(time), F.desc("theme_instance_id"))
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
