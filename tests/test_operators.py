"""Small fixtures with known results, and invariants of operators that SQL does not express."""

import json
import time
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.config import LAYERS, BuildConfig, layer_scales
from plumbline.operators import alpha, communities, diagnostics, features, forest, graph, paths, pit, qa, semantics
from plumbline.schemas import EDGES, conform
from plumbline.sinks import Store, TableSink, ThemeStore, flattened, replace_table, replaced_layers, write_shards
from plumbline.sources.events import MonthEvents, MonthPack, ParquetEvents, first_groups, normalized_edges, partitions, read_shard, read_splits
from plumbline.streaming.hysteresis import Hysteresis, replay, replay_stream

T0 = datetime(2024, 1, 2, 14, 30)


def minutes(n):
    return T0 + timedelta(minutes=n)


def test_registry():
    assert len(LAYERS) == 15
    scales = layer_scales()
    assert len(scales) == 35
    assert [sum(s.lookback == n for s in scales) for n in (5, 15, 30)] == [10, 11, 14]
    assert {s.step for s in scales} == {1}
    assert {s.role for s in scales} == {"trigger", "confirm", "structural"}


def test_parameters():
    config = BuildConfig(graph_parameter_overrides={"family:trade_flow": {"top_k": 7}, "layer:signed_flow": {"degree_cap": 4, "minimum_similarity": 0.2}, "scale:signed_flow:30": {"minimum_similarity": 0.4}, "signed_flow": {"top_k": 1}})
    p5, p30 = (config.parameters_for("signed_flow", "trade_flow", n) for n in (5, 30))
    assert (p5.top_k, p5.degree_cap, p5.minimum_similarity) == (7, 4, 0.2)
    assert (p30.top_k, p30.degree_cap, p30.minimum_similarity) == (7, 4, 0.4)
    same_name = BuildConfig(graph_parameter_overrides={"layer:x": {"top_k": 7}}).parameters_for("y", "x", 5)
    assert (same_name.top_k, same_name.degree_cap, same_name.minimum_similarity) == (8, 6, 0.1)
    with pytest.raises(ValueError):
        BuildConfig(top_k=2, degree_cap=3).parameters_for("x", "y", 5)
    with pytest.raises(ValueError):
        BuildConfig(graph_parameter_overrides={"family:y": {"nope": 1}}).parameters_for("x", "y", 5)
    assert config.digest() == config.digest() != BuildConfig().digest()


def test_panel_never_looks_ahead(spark):
    events = spark.createDataFrame([("A", minutes(0), minutes(5), 100.0), ("A", minutes(5), minutes(15), 101.0)], "symbol string, timestamp timestamp, available_time timestamp, close double")
    panel = pit.pit_panel(events, pit.decision_grid(events, "5 minutes"), events.select("symbol").distinct(), "20 MINUTES", ["close"])
    rows = panel.orderBy("decision_time").collect()
    assert [r.close for r in rows] == [100.0, 100.0, 101.0]
    assert pit.panel_audit(panel).first().asDict() == {"row_count": 3, "look_ahead_rows": 0, "duplicate_rows": 0}
    early = pit.pit_panel(events.where("close = 100"), pit.decision_grid(events, "5 minutes"), events.select("symbol").distinct(), "20 MINUTES", ["close"])
    assert early.where(F.col("decision_time") < F.lit(minutes(15))).collect() == panel.where(F.col("decision_time") < F.lit(minutes(15))).collect()


def test_session_grid(spark):
    events = spark.createDataFrame([(datetime(2024, 6, 3, 13, 30), datetime(2024, 6, 3, 13, 31)), (datetime(2024, 6, 3, 19, 55), datetime(2024, 6, 3, 20, 15))], "timestamp timestamp, available_time timestamp")
    grid = [r[0] for r in pit.decision_grid(events, "5 minutes", F.lit(datetime(2024, 6, 3, 20, 0))).orderBy("decision_time").collect()]
    assert len(grid) == 78 and grid[0] == datetime(2024, 6, 3, 13, 35) and grid[-1] == datetime(2024, 6, 3, 20, 0)


def test_labels(spark):
    panel = spark.createDataFrame([(minutes(5 * n), "A", c) for n, c in enumerate((100.0, 101.0, 103.0, 104.0, 108.0))], "decision_time timestamp, symbol string, close double")
    out = {r.decision_time: r.label_5 for r in pit.forward_labels(panel, [5], 5).collect()}
    assert out[T0] == pytest.approx(103 / 101 - 1)
    assert out[minutes(15)] is None


def test_split_multiplier(spark):
    splits = pit.normalized_splits(spark.createDataFrame([(" a", datetime(2024, 1, 3).date(), 2.0), ("A", datetime(2024, 1, 3).date(), 2.0), ("A", datetime(2024, 1, 3).date(), 1.5), ("A", datetime(2024, 1, 9).date(), None)], "symbol string, effective_date date, ratio double"))
    assert [tuple(r)[2:] for r in splits.collect()] == [(3.0, 2)]
    spans = spark.createDataFrame([("A", datetime(2024, 1, 2).date(), datetime(2024, 1, 3).date()), ("A", datetime(2024, 1, 3).date(), datetime(2024, 1, 4).date())], "symbol string, entry_date date, exit_date date")
    assert sorted(r.multiplier for r in pit.cumulative_multiplier(spans, splits).collect()) == [1.0, 3.0]


def test_degree_cap():
    edges = pd.DataFrame({"src_id": [0, 0, 1, 2], "dst_id": [1, 2, 2, 3], "weight": [0.99, 0.98, 0.97, 0.96]})
    assert list(zip(graph.capped(edges, 1)["src_id"], graph.capped(edges, 1)["dst_id"])) == [(0, 1), (2, 3)]
    assert graph.capped(edges, 0).empty


def test_topk_matches_plain_search(spark):
    x = np.random.default_rng(7).standard_normal((20, 12))
    vectors = spark.createDataFrame([(1, n, v.tolist()) for n, v in enumerate(x)] + [(1, 99, [0.0] * 12)], "layer_id int, node_id long, vector array<double>")
    got = {(r.src_id, r.dst_id) for r in graph.directed_topk(vectors, ["layer_id"], 3, 0.1, block=7).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert got == {(i, int(j)) for i in range(20) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.1}


def test_lsh_finds_within_reach(spark):
    x = np.random.default_rng(3).standard_normal((60, 64))
    vectors = spark.createDataFrame([(1, n, v.tolist()) for n, v in enumerate(x)], "layer_id int, node_id long, vector array<double>")
    coded = graph.lsh_codes(vectors, 64, 6)
    code = {r.node_id: r.code for r in coded.collect()}
    signs = (x @ graph.lsh_projection(64, 6).astype(float)) > 0
    assert code == {n: int(sum(1 << b for b in range(6) if signs[n, b])) for n in range(60)}
    out = graph.lsh_topk(coded, ["layer_id"], 6, 4, -1.0).collect()
    assert out and all(r.src_id != r.dst_id and bin(code[r.src_id] ^ code[r.dst_id]).count("1") <= 2 for r in out)
    assert max(r["rank"] for r in out) <= 4


DIAG = "decision_time timestamp, layer_id int, lookback_minutes int, src_id int, dst_id int, weight double"


def test_diagnostics(spark):
    rows = [(T0, 2, 5, 0, 1, 0.9), (T0, 2, 5, 1, 2, 0.8), (minutes(1), 2, 5, 0, 1, 0.95), (minutes(1), 2, 5, 2, 3, 0.7), (minutes(1), 4, 5, 1, 0, 0.85)]
    edges = spark.createDataFrame(rows, DIAG)
    th = diagnostics.strong_thresholds(edges)
    q = {r.layer_id: r for r in th.collect()}
    assert (q[2].q80, q[2].q90, q[2].q95) == pytest.approx(tuple(np.quantile([0.9, 0.8, 0.95, 0.7], [0.8, 0.9, 0.95])))
    first = diagnostics.snapshot_diagnostics(edges, 5, th).where("layer_id = 2").orderBy("decision_time").first()
    assert (first.edge_count, first.active_nodes, first.node_coverage, first.isolated_node_ratio, first.strong_edge_ratio_q90) == (2, 3, 0.6, 0.4, 0)
    one, two = diagnostics.temporal_diagnostics(edges, th).where("layer_id = 2").orderBy("decision_time").collect()
    assert (one.all_birth_rate, one.strong_jaccard) == (None, None)
    assert (two.all_birth_rate, two.all_death_rate, two.all_persistence, two.all_jaccard) == pytest.approx((0.5, 0.5, 0.5, 1 / 3))
    assert (two.strong_birth_rate, two.strong_death_rate, two.strong_persistence) == (1.0, 0.0, 0.0)
    res = diagnostics.resonance(edges, spark.createDataFrame([(2, "activity"), (4, "trade_flow")], "layer_id int, family string")).orderBy(F.desc("decision_time")).first()
    assert (res.resonant_edges_ge2_layers, res.resonant_edges_ge2_families, res.core_nodes_ge5_layers, res.mean_edge_layer_support, res.mean_node_layer_participation) == (1, 1, 0, 1.5, 1.5)


def test_exact_quantiles_of_large_groups(spark, monkeypatch):
    """Brackets of a sketch against numpy, with ties, small groups and missing values."""
    from plumbline.functions import quantiles

    monkeypatch.setattr(quantiles, "SMALL", 20_000)
    rng = np.random.default_rng(5)
    groups = {1: rng.random(60_000), 2: np.round(rng.random(30_000), 2), 3: np.array([0.5]), 4: rng.normal(size=7)}
    frame = pd.DataFrame([(g, v) for g, x in groups.items() for v in x] + [(1, None)], columns=["g", "v"])
    got = {r.g: (r.a, r.b, r.c) for r in quantiles.exact_quantiles(spark.createDataFrame(frame), ["g"], "v", {"a": 0.5, "b": 0.9, "c": 0.99}).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g] == pytest.approx(tuple(np.quantile(x, [0.5, 0.9, 0.99])), abs=1e-12)


def test_communities_measured(spark):
    """Two triangles joined by a weak edge, by hand."""
    edges = [(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (4, 5, 1.0), (4, 6, 1.0), (5, 6, 1.0), (3, 4, 0.5)]
    df = spark.createDataFrame([(0, a, b, w) for a, b, w in edges], "g int, src_id int, dst_id int, weight double")
    members = spark.createDataFrame([(0, n, int(n > 3)) for n in range(1, 7)] + [(0, 9, 2)], "g int, node_id int, community_id int")
    r = diagnostics.community_metrics(df, members, ["g"], 10, 0.5).first()
    assert (r.community_count, r.top_community_coverage) == (3, 0.3) and r.community_hhi == pytest.approx((9 + 9 + 1) / 49)
    assert r.weighted_modularity == pytest.approx(2 * (3 / 6.5 - 0.25)) and r.within_community_weight_ratio == pytest.approx(6 / 6.5)
    assert r.cpm_quality == pytest.approx(2 * (2 * (3 - 0.5 * 3)))


def test_components_of_whole_graphs(spark):
    from plumbline.plans import catalog, inputs

    sf = "/root/testdata/sf0.001"
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for e in inputs.edges(spark, sf).collect():
        a, b = sorted(find((str(e.decision_time), e.layer_id, n)) for n in (e.src_id, e.dst_id))
        root[b] = a
    want = {x: find(x)[2] for x in root}
    got = catalog.QUERIES["graph_components"](spark, sf).collect()
    assert {(r.decision_time, r.layer_id, r.node_id): r.component_id for r in got} == want and len(got) == len(want)
    metrics = {(r.decision_time, r.layer_id): r for r in catalog.QUERIES["component_metrics"](spark, sf).collect()}
    for key, r in metrics.items():
        sizes = list(Counter(c for x, c in want.items() if x[:2] == key).values())
        assert (r.component_count, r.giant_component_coverage) == (len(sizes), round(max(sizes) / 200, 6))
        assert r.component_size_hhi == pytest.approx(sum(n * n for n in sizes) / sum(sizes) ** 2, abs=1e-6)
    assert set(metrics) == {x[:2] for x in want}


def test_forest_partitions_members(spark):
    rng = np.random.default_rng(1)
    pairs = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, 300, 2000), rng.integers(0, 300, 2000), rng.random(2000)) if a < b}
    df = spark.createDataFrame([(T0, 1, "30", a, b, w) for (a, b), w in pairs.items()], "decision_time timestamp, layer_id int, scale string, a long, b long, weight double")
    rows = forest.build_forest(df).toPandas()
    nodes = {n for p in pairs for n in p}
    for level, most in (("B50", 50), ("B35", 50)):
        m = rows[(rows.kind == "member") & (rows.level == level)]
        assert set(m.member_id) == nodes and len(m) == len(nodes)
        assert m.groupby("theme_id").size().max() <= most
    assert set(rows[rows.kind == "edge"].parent_theme_id) <= set(rows[rows.kind == "node"].theme_id)


def test_communities():
    nodes, of = communities.moved_communities(np.array([1, 1, 2, 4, 4, 5, 3]), np.array([2, 3, 3, 5, 6, 6, 4]), np.array([1, 1, 1, 1, 1, 1, 0.1]))
    assert nodes.tolist() == [1, 2, 3, 4, 5, 6] and of.tolist() == [0, 0, 0, 1, 1, 1]


UNITS = "snapshot_time timestamp, layer_name string, community_id int, members array<long>, is_market_mode boolean"


def test_consensus(spark):
    rows = [(T0, "return_corr_raw_1m@15m", 0, [1, 2, 3], False), (T0, "signed_flow@15m", 0, [1, 2, 3], False)]
    c = spark.createDataFrame(rows, UNITS)
    families = {"return_corr_raw_1m": "price", "signed_flow": "flow"}
    theme = communities.consensus_themes(c, families, least=0.5, universe=100).collect()
    assert len(theme) == 1 and theme[0].source_families == ["flow", "price"] and theme[0].members == [1, 2, 3]
    assert (theme[0].consensus_score, theme[0].structure_score, theme[0].size_share, theme[0].theme_path_id) == (2.0, 1.0, 0.03, "run_new_0001")
    both = c.withColumn("layer_name", F.lit("signed_flow@15m"))
    assert communities.consensus_themes(both, families, least=0.5).count() == 0


def test_consensus_of_pairs_below_the_threshold(spark):
    """Pairs that score below the threshold make no link, but count in a theme's mean score and its layers."""
    rows = [(T0, "a", 0, [1, 2, 3], False), (T0, "b", 0, [1, 2], False), (T0, "b", 1, [2, 3], False), (T0, "c", 0, [1, 3], False), (T0, "a", 9, [1, 2], True), (T0, "return_corr", 0, [1, 3], False)]
    theme = communities.consensus_themes(spark.createDataFrame(rows, UNITS), {"a": "x", "b": "y", "c": "z"}, least=1.2, weights={"c": 0.1}).collect()
    assert len(theme) == 1 and theme[0].members == [1, 2, 3]
    assert theme[0].consensus_score == pytest.approx((2 * 2.0 + 1.1) / 3) and theme[0].source_layers == ["a", "b", "c"]


def random_units(rng, members, layers=3, communities=5):
    """Overlapping communities of two times, with repeated rows, market mode and an excluded layer."""
    rows = []
    for at in (T0, minutes(15)):
        for layer in range(layers):
            for c in range(communities):
                some = rng.choice(members, int(rng.integers(2, members // 2)), replace=False).tolist()
                rows.append((at, f"l{layer}@15m", c, some + some[:1], bool(rng.random() < 0.1)))
        rows += [(at, "return_corr@15m", 0, list(range(members)), False), rows[-1], (at, "l0@15m", 99, [], False)]
    return rows


def plain_scores(rows, weights):
    score, layers = Counter(), {}
    for time, layer, _, members, market in rows:
        bare = layer.removesuffix("@15m")
        if market or bare == "return_corr":
            continue
        m = sorted(set(members))
        for i, a in enumerate(m):
            for b in m[i + 1 :]:
                score[time, a, b] += weights.get(bare, 1.0)
                layers.setdefault((time, a, b), set()).add(bare)
    return score, layers


def test_pair_scores_of_classes(spark, monkeypatch):
    """Every pair that scores enough, and no other, from classes of members; two communities of 4,000 make no pair but their common ones."""
    rng, weights = np.random.default_rng(11), {"l1": 0.25}
    monkeypatch.setattr(communities, "SLICE", 3)
    rows = random_units(rng, 40)
    want, layers = plain_scores(rows, weights)
    for least in (0.0, 1.2):
        got = {(r.snapshot_time, r.a, r.b): (r.score, set(r.layers)) for r in communities.pair_scores(spark.createDataFrame(rows, UNITS), weights, least=least).collect()}
        assert got == {k: (pytest.approx(v), layers[k]) for k, v in want.items() if v >= least} and got
    large = spark.createDataFrame([(T0, "a", 0, list(range(4000)), False), (T0, "b", 0, list(range(3990, 8000)), False)], UNITS)
    classes, scores = communities.class_scores(large)
    assert classes.count() == 3 and scores.count() == 5
    assert communities.pair_scores(large, least=1.5).count() == 45


def test_themes_of_classes(spark):
    """Themes of linked classes and of classes alone: members by plain moves or whole, means over all scored pairs inside, numbers by least member."""
    rng, weights = np.random.default_rng(5), {"l1": 0.25}
    rows = random_units(rng, 30)
    for time in (T0, minutes(15)):
        rows += [(time, "l0@15m", 50, list(range(100, 140)), False), (time, "l2@15m", 50, list(range(100, 140)), False), (time, "l2@15m", 51, [20, 100, 101], False)]
    score, layers = plain_scores(rows, weights)
    families = {"l0": "x", "l1": "y", "l2": "z"}
    got = communities.consensus_themes(spark.createDataFrame(rows, UNITS), families, least=2.0, weights=weights, universe=150).collect()
    for time in (T0, minutes(15)):
        strong = {k[1:]: v for k, v in score.items() if k[0] == time and v >= 2.0}
        a, b = (np.array([k[i] for k in sorted(strong)]) for i in (0, 1))
        w = np.array([strong[k] for k in sorted(strong)])
        inner = [x for c in ({100, 101}, set(range(102, 140))) for x in c]
        assert set(inner) <= set(a.tolist()) | set(b.tolist())
        mine = sorted((r for r in got if r.snapshot_time == time), key=lambda r: r.members[0])
        assert [r.theme_path_id for r in mine] == sorted(r.theme_path_id for r in mine)
        assert any(set(range(102, 140)) <= set(r.members) for r in mine)
        total, degree, near = 2 * w.sum(), Counter(), {}
        for x, y, v in zip(a.tolist(), b.tolist(), w.tolist()):
            degree.update({x: v, y: v})
            near.setdefault(x, {})[y] = near.setdefault(y, {})[x] = v
        gain = lambda n, some: sum(v for o, v in near[n].items() if o in some and o != n) - degree[n] * sum(degree[o] for o in some if o != n) / total  # noqa: B023, E731
        for r in mine:
            inside = [k for i, x in enumerate(r.members) for y in r.members[i + 1 :] if (k := (time, x, y)) in score]
            assert r.consensus_score == pytest.approx(sum(score[k] for k in inside) / len(inside)) and r.source_layers == sorted(set().union(*(layers[k] for k in inside)))
            assert r.is_market_mode == (len(r.members) > 22.5) and r.size_share == pytest.approx(len(r.members) / 150)
            for n in r.members:
                assert all(gain(n, r.members) >= gain(n, o.members) - 1e-9 for o in mine if o is not r)


def test_themes_of_large_communities(spark):
    """Two communities of 3,000 are one class, and 4.5 million pairs are never made."""
    one = spark.createDataFrame([(T0, layer, 0, list(range(3000)), False) for layer in ("a", "b")], UNITS)
    began = time.perf_counter()
    theme = communities.consensus_themes(one, {"a": "x", "b": "y"}, least=2.0).collect()
    assert len(theme) == 1 and theme[0].members == list(range(3000)) and theme[0].consensus_score == 2.0 and time.perf_counter() - began < 20


def test_lifecycle_reads_kept_themes(spark):
    """The lifecycle's plan, and that of the latest events, begin at the communities that were found once."""
    from plumbline.plans import catalog

    for name in ("theme_lifecycle", "theme_latest"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
        assert "ExistingRDD" in plan or "LogicalRDD" in plan or "parquet" in plan
        assert "layer_name" not in plan and "events" not in plan


def test_lifecycle(spark):
    rows = [(T0, "a", [1, 2, 3]), (T0, "z", [50, 51]), (minutes(15), "b", [1, 2, 3, 4]), (minutes(15), "c", [2, 3]), (minutes(30), "d", [9, 10])]
    out = {(r.theme_instance_id, r.event_type): r for r in communities.lifecycle(spark.createDataFrame(rows, "snapshot_time timestamp, theme_instance_id string, members array<long>"), 15).collect()}
    assert out["b", "continuation"].theme_path_id == "a" and out["b", "continuation"].age_frames == 2
    assert out["c", "split"].previous_instance_id == "a"
    assert ("z", "death") in out and ("d", "birth") in out and ("b", "death") in out


def share(a, b, whole):
    return len(a & b) / (len(a | b) if whole else min(len(a), len(b)))


def plain_paths(frames, arm):
    """PATH rows of one arm, all told from histories alone: a path is the list of (frame, community) that it had.

    frames: lists of communities, each in order of members.
    """
    r = dict(zip(paths.ARM_FIELDS, paths.ARMS[arm]))
    histories = []
    for t, now in enumerate(frames):
        value = {}
        for i, h in enumerate(histories):
            gap = t - 1 - h[-1][0]
            if gap > max(r["dormant"], r["weak"] * (not r["dormant"])):
                continue
            for n, c in enumerate(now):
                cont, jac, mark = share(h[-1][1], c, False), share(h[-1][1], c, True), share(h[0][1], c, True)
                rules = {
                    "new": cont >= r["entry_cont"] and mark >= r["entry_fp"],
                    "active": cont >= min(r["stay"], r["assist_cont"] if mark >= r["assist_fp"] else 9),
                    "missing": gap <= r["dormant"] and mark >= r["rev_fp"] and len(c) >= (1 + r["breadth"]) * len(h[-1][1]),
                }
                if cont and rules["new" if len(h) == 1 else "missing" if gap else "active"]:
                    value[i, n] = cont + jac / 2 + mark / 2
        while value:
            i, n = max(value, key=lambda k: (value[k], k))
            histories[i].append((t, now[n]))
            value = {k: v for k, v in value.items() if k[0] != i and k[1] != n}
        begun = {id(c) for h in histories for f, c in h if f == t}
        histories += [[(t, c)] for c in now if id(c) not in begun]
    out = []
    for i, h in enumerate(histories):
        steps = np.diff([f for f, _ in h])
        back = [k for k in range(1, len(steps)) if steps[k] > 1]
        kept = [k for k in back if len(steps) - k > r["post"] and all(steps[k + 1 : k + 1 + r["post"]] == 1)]
        out.append((arm, i, h[0][0], h[-1][0], len(h), len(h) > 1, len(back), len(kept)))
    return out


def test_paths(spark):
    rng = np.random.default_rng(3)
    groups, rows = {}, []
    for g in range(3):
        base = [set(range(30 * k, 30 * k + 25)) for k in range(4)]
        frames = []
        for t in range(25):
            now = []
            for k, c in enumerate(base):
                c ^= {int(x) for x in rng.integers(0, 150, rng.integers(0, 9))}
                if rng.random() < 0.7 and len(c) >= 20:
                    now.append(frozenset(c))
            frames.append([frozenset(c) for c in sorted(map(sorted, now))] or [frozenset(range(200, 222))])
        groups[f"g{g}"] = frames
        rows += [(f"g{g}", minutes(5 * t), sorted(c)) for t, f in enumerate(frames) for c in f]
    df = spark.createDataFrame(rows, "name string, snapshot_time timestamp, members array<long>").repartition(5)
    got = {tuple(r) for r in paths.track_paths(df, ["name"]).collect()}
    want = {(g, *r) for g, frames in groups.items() for arm in paths.ARMS for r in plain_paths(frames, arm)}
    assert got == want and any(r[7] for r in want) and any(r[8] for r in want)


def test_arm_summary(spark):
    rows = [("d1", "x", "A", 0, 0, 3, 3, True, 0, 0), ("d1", "x", "A", 1, 0, 11, 9, True, 2, 1), ("d2", "x", "A", 0, 2, 4, 2, True, 1, 0), ("d3", "x", "A", 0, 0, 0, 1, False, 0, 0), ("d1", "x", "B", 0, 0, 11, 12, True, 1, 1), ("d1", "y", "A", 0, 0, 0, 1, False, 0, 0)]
    df = spark.createDataFrame(rows, f"date string, layer_name string, {paths.PATH}")
    out = {(r.layer_name, r.arm): r for r in paths.arm_summary(df).collect()}
    a = out["x", "A"]
    assert (a.days, a.confirmed_paths, a.days_with_paths) == (3, 3, 2)
    assert a.median_life == pytest.approx((2 * 40 + 15) / 3) and a.mean_hits == pytest.approx(14 / 3)
    assert (a.s15, a.s30, a.s60) == pytest.approx((1, 1 / 3, 1 / 3)) and a.revival_rate == pytest.approx(2 / 3)
    assert a.score == pytest.approx(0.35 + 0.35 / 3 + 0.15 / 3 + 0.1 / 3 - 0.1 / 3 + 0.05 * 3 / 1000)
    y = out["y", "A"]
    assert (y.days, y.confirmed_paths, y.days_with_paths, y.score) == (1, 0, 0, None)
    best = {r.layer_name: r.arm for r in paths.recommended_arms(paths.arm_summary(df)).collect()}
    assert best == {"x": "B", "y": "A"}


EDGE_ROWS = "decision_time timestamp, layer_id int, lookback_minutes int, src_id long, dst_id long, weight double"


def test_hysteresis(spark):
    rows = [(T0, 1, 30, 10, 20, 0.8), (T0, 1, 30, 10, 30, 0.7), (minutes(1), 1, 30, 10, 20, 0.6)]
    edges = spark.createDataFrame(rows, EDGE_ROWS)
    frames = spark.createDataFrame([(minutes(n), 1, 30) for n in range(4)], "decision_time timestamp, layer_id int, lookback_minutes int")
    out = [(r.decision_time, r.src_id, r.dst_id, round(r.weight, 6), r.temporal_status) for r in replay(edges, Hysteresis(), frames).orderBy("decision_time").collect()]
    assert out == [(T0, 10, 20, 0.8, "active"), (minutes(1), 10, 20, 0.68, "active"), (minutes(2), 10, 20, 0.68, "grace")]


def test_hysteresis_of_every_layer(spark):
    from plumbline.plans import catalog, inputs

    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in catalog.QUERIES["hysteresis_replay"](spark, sf).collect()}
    columns, want = catalog.QUERIES["hysteresis_replay"](spark, sf).columns, set()
    for layer in (1, 2, 3):
        one = replay(inputs.edges(spark, sf).where(f"layer_id = {layer}"), Hysteresis(0.6, 0.6, 0.5, 1))
        rows = catalog.rounded(one.withColumn("decision_time", catalog.day("decision_time")), "weight").select(*columns).collect()
        assert rows and {r.layer_id for r in rows} == {layer}
        want |= {tuple(r) for r in rows}
    assert got == want


def test_hysteresis_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(minutes(t), 1, 30, int(i), int(i) + 1, float(rng.random())) for t in range(6) for i in rng.choice(8, 5, replace=False)]
    place = str(tmp_path / "in")
    for t in range(6):
        spark.createDataFrame([r for r in rows if r[0] == minutes(t)], EDGE_ROWS).coalesce(1).write.mode("append").parquet(place)
    config = Hysteresis(0.6, 0.5, 0.4, 1)
    source = spark.readStream.schema(spark.read.parquet(place).schema).option("maxFilesPerTrigger", 1).parquet(place)
    q = replay_stream(source, config).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.decision_time, r.src_id, r.dst_id, round(r.weight, 9), r.temporal_status)
    want = sorted(map(key, replay(spark.createDataFrame(rows, EDGE_ROWS), config).collect()))
    assert sorted(map(key, spark.table("replayed").collect())) == want


def test_schema_contract(spark):
    df = spark.createDataFrame([(1, 2)], "src_id long, dst_id long")
    assert conform(df, EDGES).schema == EDGES
    with pytest.raises(ValueError):
        conform(df.withColumn("extra", F.lit(1)), EDGES)


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    edges = spark.createDataFrame([(1, 1, 2, 0.5), (2, 1, 2, 0.7)], "layer_id int, src_id int, dst_id int, weight double")
    for date in ("2024-01-02", "2024-01-03", "2024-01-02"):
        assert store.write_day("edges", edges, date) == 2
    store.write_dimensions(spark.createDataFrame([("B",), ("A",)], "symbol string"))
    store.write_dimensions(spark.createDataFrame([("0",), ("A",)], "symbol string"))
    assert {r.symbol: r.symbol_id for r in store.read("symbols").collect()} == {"A": 0, "B": 1, "0": 2}
    assert set(store.catalog()) == {"symbols", "layers", "edges", "metadata"}
    assert spark.sql("SELECT count(*) FROM edges").first()[0] == 4 and spark.sql("SELECT value FROM metadata WHERE key = 'schema_version'").first()[0] == "canonical-v1"
    assert json.loads((tmp_path / "store/row_counts/date=2024-01-03.json").read_text()) == {"edges": 2, "node_features": 0, "snapshots": 0, "labels": 0}
    store.write_manifest("2024-01-02", BuildConfig(), {"files": 1}, 3, ["x"])
    value = store.write_manifest("2024-01-03", BuildConfig(), {"files": 2}, 3, ["x"])
    assert set(value["dates"]) == {"2024-01-02", "2024-01-03"} and value["dates"]["2024-01-03"]["edges"] == 2 and value["config_hash"] == BuildConfig().digest()
    wanted = spark.createDataFrame([("2024-01-03",), ("2024-01-04",)], "date string").withColumn("date", F.to_date("date"))
    assert [str(r.date) for r in store.pending(wanted, "edges", ["date"]).collect()] == ["2024-01-04"]


def test_sink_of_batches(spark, tmp_path):
    for kind in ("parquet", "csv"):
        sink = TableSink(str(tmp_path / kind), kind)
        sink.write(spark.createDataFrame([], "a int, b string"))
        sink.write(spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string"))
        sink.write(spark.createDataFrame([("3",)], "a string"))
        with pytest.raises(ValueError):
            sink.write(spark.createDataFrame([(1,)], "c int"))
        back = spark.read.parquet(sink.path) if kind == "parquet" else spark.read.option("header", "true").csv(sink.path)
        assert sink.rows == 3 and sorted(int(r.a) for r in back.collect()) == [1, 2, 3]


def test_semantics(spark):
    """By hand: ties go to the first member, coherence is over known members, the fallback counts families."""
    meta = spark.createDataFrame([(1, "A", "Ann", "Tech", "Chips", 1e9), (2, "B", "Bob", "Oil", "Gas", 3e9), (3, "C", None, None, "Gas", 5e9)], "symbol_id int, symbol string, company string, sector string, industry string, market_cap double")
    themes = spark.createDataFrame([("t", [3, 2, 1, 9], ["flow"], False), ("u", [8, 9], ["flow", "price"], True)], "theme_instance_id string, members array<int>, source_families array<string>, is_market_mode boolean")
    out = {r.theme_instance_id: r for r in semantics.labels(themes, meta).collect()}
    t, u = out["t"], out["u"]
    assert (t.sector_summary, t.industry_summary, t.market_cap_bucket, t.semantic_coherence_score) == ("Oil", "Gas", "Mid-Cap", pytest.approx(1 / 3))
    assert t.label_short == "Oil/Gas (Mid-Cap): C, B, A" and t.tags == ["Gas", "Oil", "flow"] and t.top_companies == ["Bob", "Ann"] and json.loads(t.industry_distribution) == {"Gas": 0.666667, "Chips": 0.333333}
    assert (u.label_short, u.semantic_coherence_score, u.tags) == ("Market Mode: Mixed/Mixed (Unknown)", pytest.approx(0.6), ["flow", "price"])
    s = {r.theme_instance_id: r for r in semantics.member_summary(themes, meta, ["theme_instance_id"]).collect()}
    assert (s["t"].metadata_coverage, s["t"].top_symbols, s["t"].top_companies, s["t"].top_sector, s["t"].top_sector_share, s["t"].top_industry_share) == (0.75, "C,B,A", "Bob | Ann", "Oil", 0.5, pytest.approx(2 / 3))
    assert (s["u"].top_sector, s["u"].top_industry_share, s["u"].market_cap_bucket, s["u"].metadata_coverage) == ("Unknown", 0.0, "Unknown", 0.0)
    nodes = spark.createDataFrame([("d", 0, "split", 40), ("d", 0, "whole", 20), ("d", 1, None, 9)], "date string, level int, split_status string, member_count int")
    assert semantics.forest_summary(nodes, ["date"]).first()[1:] == (2, 1, 1, 30.0, 9.0)


def test_theme_store(spark, tmp_path):
    store = ThemeStore(spark, str(tmp_path / "themes"))
    meta = spark.createDataFrame([(1, "A", "Ann", "Tech", "Chips", 1e9)], "symbol_id long, symbol string, company string, sector string, industry string, market_cap double")
    for n, date in enumerate(("2024-01-02", "2024-01-03")):
        rows = [(minutes(1440 * n), f"i{n}", "p", [1, 2], ["flow"], False, 0.5, 0.6, 0.7, 0.2, '{"flow": 0.2}')]
        themes = spark.createDataFrame(rows, "snapshot_time timestamp, theme_instance_id string, theme_path_id string, members array<long>, source_families array<string>, is_market_mode boolean, structure_score double, consensus_score double, stability_score double, flow_support_score double, quality_breakdown string")
        assert store.write_themes(date, themes=themes) == {"themes": 1}
    assert set(store.build_read_models()) == {"theme_events", "active_theme_paths"}
    assert [r.theme_instance_id for r in spark.read.parquet(f"{store.root}/read_models/active_theme_paths").collect()] == ["i1"]
    assert store.relabel(meta) == {"2024-01-02": 1, "2024-01-03": 1}
    r = store.day("themes", "2024-01-03").first()
    assert r.semantic_coherence_score == 1.0 and r.theme_quality_score == pytest.approx(0.175 + 0.15 + 0.14 + 0.1 + 0.02) and json.loads(r.quality_breakdown) == {"flow": 0.2, "semantic": 1.0}
    assert store.day("semantics", "2024-01-02").first().sector_summary == "Tech"
    with pytest.raises(ValueError):
        store.write_themes("2024-01-02", nonsense=themes)


def test_alpha(spark):
    """Past labels end by now; weighted means divide by all scores; births have no predecessor."""
    labels = spark.createDataFrame([("A", minutes(5 * n), float(n), 10.0 * n) for n in range(6)], "symbol string, decision_time timestamp, label_5 double, label_10 double")
    past = {r.decision_time: r for r in alpha.past_labels(labels, [5, 10], 5).collect()}
    assert (past[minutes(20)].past_label_5, past[minutes(20)].past_label_10, past[minutes(5)].past_label_5) == (2.0, 10.0, None)
    assert {r.decision_time: r.past_label_5 for r in alpha.past_labels(labels, [5], 5, legacy=True).collect()}[minutes(20)] == 3.0
    members = spark.createDataFrame([(T0, 1, "5m", "B35", "t", m, c) for m, c in (("A", 1.0), ("B", 0.5), ("C", 0.5))], "decision_time timestamp, layer_id int, scale string, level string, theme_id string, member_id string, core_score double")
    values = spark.createDataFrame([(T0, "A", 0.1, 1.0), (T0, "B", 0.4, None), (T0, "C", None, None)], "decision_time timestamp, symbol string, label_5 double, past_label_5 double")
    r = alpha.theme_returns(members, values).first()
    assert (r.member_count, r.ret_eq_5, r.ret_core_5, r.past_eq_5, r.past_core_5, r.past_top5_5) == pytest.approx((3, 0.25, 0.15, 1.0, 0.5, 1.0))
    themes = spark.createDataFrame([(T0, 1, "a", 0.1), (minutes(5), 1, "b", 0.2), (minutes(5), 1, "c", 0.5)], "decision_time timestamp, layer_id int, theme_id string, x double")
    after = spark.createDataFrame([(1, minutes(5), "b")], "layer_id int, dst_time timestamp, dst_theme_id string")
    out = {r.decision_time: r for r in alpha.theme_birth(alpha.births(themes, after, ["layer_id"]), "x").collect()}
    assert (out[minutes(5)].born, out[minutes(5)].excess, out[T0].born, out[T0].old_return) == (1, pytest.approx(0.3), 1, None)


def test_qa(spark, tmp_path):
    import hashlib

    df = spark.createDataFrame([(T0, 1), (minutes(3), 2)], "t timestamp, x int")
    df.coalesce(1).write.parquet(str(tmp_path / "a/b"))
    (row,) = qa.artifact_manifest(spark, str(tmp_path / "a"), "t").collect()
    (file,) = (tmp_path / "a/b").glob("*.parquet")
    assert (row.file, row.size_bytes, row.sha256) == (file.name, file.stat().st_size, hashlib.sha256(file.read_bytes()).hexdigest())
    assert (row.row_count, row.schema, row.min_time, row.max_time) == (2, "t|x", T0, minutes(3))
    assert "## none\n\nNo data." in qa.report({"some": df, "none": df.limit(0)}, "Report") and "| 2 |" in qa.report({"some": df.select("x")}, "Report")
    closed = spark.createDataFrame([(datetime(2024, 1, 2, 15, 14, 59),), (datetime(2024, 1, 2, 15, 15),), (datetime(2024, 1, 2, 15, 15, 1),)], "timestamp timestamp")
    assert [pit.session_filter(closed, "America/New_York", "10:00", "10:15", closed=c).count() for c in (False, True)] == [1, 2]
    twice = spark.createDataFrame([(T0, "A", 1.0), (T0, "A", 2.0)], "decision_time timestamp, symbol string, close double")
    with pytest.raises(Exception, match="repeated key of features"):
        features.wide_matrix(twice, spark.createDataFrame([(T0, "A", 1.0)], "decision_time timestamp, symbol string, label_5 double")).collect()


def test_prefix_difference(spark):
    """A panel does not change when what is not yet available is taken away; one that looks ahead does."""
    rng = np.random.default_rng(2)
    rows = [(f"S{s}", minutes(n), minutes(n + int(rng.integers(0, 9))), float(rng.random())) for s in range(5) for n in range(60)]
    events = spark.createDataFrame(rows, "symbol string, timestamp timestamp, available_time timestamp, close double")
    grid = pit.decision_grid(events, "5 minutes")
    fair = lambda e: pit.pit_panel(e, grid, events.select("symbol").distinct(), "30 MINUTES", ["close"])
    ahead = lambda e: grid.join(e, F.col("timestamp") <= F.col("decision_time")).select("decision_time", "symbol", "close")
    assert pit.prefix_difference(fair, events, minutes(30)).count() == 0 < pit.prefix_difference(ahead, events, minutes(30)).count()


def test_patch(spark, tmp_path):
    keys = ["layer_id", "src_id", "dst_id"]
    base = spark.createDataFrame([(1, 1, 2, 0.5), (2, 1, 2, 0.7)], "layer_id int, src_id int, dst_id int, weight double")
    patch = spark.createDataFrame([(n, 1, 2, 0.9) for n in (1, 14, 15)], "layer_id int, src_id int, dst_id int, weight double")
    merged, stats = replaced_layers(base, patch, [1, 14, 15], keys)
    assert sorted(r.layer_id for r in merged.collect()) == [1, 2, 14, 15]
    assert stats.first().asDict() == {"baseline_rows": 2, "preserved_rows": 1, "patch_rows": 3, "merged_rows": 4, "duplicates": 0}
    place = str(tmp_path / "t")
    base.write.parquet(place)
    replace_table(spark, place, replaced_layers(spark.read.parquet(place), patch, [1, 14, 15], keys)[0], stats)
    assert spark.read.parquet(place).count() == 4
    with pytest.raises(ValueError):
        replace_table(spark, place, base, replaced_layers(base, patch.union(patch), [1], keys)[1])


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("A", T0, minutes(1), "2024-01-02", 1.0, 5), ("B", T0, minutes(1), "2024-01-03", 2.0, 6)], "symbol string, timestamp timestamp, available_time timestamp, trade_date string, close double, n int")
    rows.write.parquet(str(tmp_path / "ev/x"))
    source = ParquetEvents(spark, str(tmp_path / "ev"))
    assert [r[0] for r in source.available_dates().collect()] == ["2024-01-02", "2024-01-03"]
    assert source.load_date("2024-01-03", ["close"]).columns == ["symbol", "timestamp", "available_time", "trade_date", "close"]
    assert source.numeric_features() == ["close", "n"]
    mark = source.fingerprint()
    assert (mark["total_rows"], mark["files"]) == (2, len(list((tmp_path / "ev/x").glob("*.parquet")))) and mark["total_bytes"] > 0 and mark == ParquetEvents(spark, str(tmp_path / "ev")).fingerprint()
    rows.withColumn("date", F.col("trade_date")).write.partitionBy("date").parquet(str(tmp_path / "pack/month=2024-01/node_factors_5m"))
    month = MonthEvents(MonthPack(spark, str(tmp_path / "pack")), "2024-01")
    assert month.pack.available_months() == ["2024-01"] and month.load_date("2024-01-02").count() == 1 and "close" in month.numeric_features()
    (tmp_path / "s.csv").write_bytes("﻿Symbol,Date,From,To\na,2024-01-02,1,2\nb,bad,x,3\n".encode())
    assert [(r.symbol, r.ratio) for r in read_splits(spark, str(tmp_path / "s.csv")).collect()] == [("a", 2.0), ("b", None)]
    e = normalized_edges(spark.createDataFrame([(1, 1, "0.5", "x"), (1, 2, None, "x"), (2, 3, "-0.4", "x"), (3, 4, "no", "x")], "source_id int, target int, edge_weight string, layer_name string"))
    assert sorted((r.src_id, r.dst_id, r.abs_weight, r.scale, r.layer_id, r.decision_time) for r in e.collect()) == [(1, 2, 0.0, "default", "x", "unknown"), (2, 3, 0.4, "default", "x", "unknown"), (3, 4, 0.0, "default", "x", "unknown")]
    assert normalized_edges(spark.createDataFrame([(1, 1, 2, 0.5, 15, T0)], "layer int, src int, dst int, score double, lookback_minutes int, ts timestamp")).first()[:3] == (T0, 1, "15m")
    with pytest.raises(ValueError):
        normalized_edges(spark.createDataFrame([(1, 2, 1)], "src_id int, dst_id int, layer_id int"))
    shards = write_shards(e.withColumn("date", F.lit("2024-01-02")), str(tmp_path / "shards"))
    assert [r.row_count for r in shards.collect()] == [3]
    found = partitions(spark, str(tmp_path / "shards"), date=["2024-01-02"], layer_id=["x"]).collect()
    assert found and found[0]["keys"]["scale"] == "default" and partitions(spark, str(tmp_path / "shards"), layer_id=["y"]).count() == 0
    e.drop("abs_weight").write.parquet(str(tmp_path / "shard"))
    assert [r.src_id for r in read_shard(spark, str(tmp_path / "shard")).collect()] == [1, 2, 3]
    assert flattened(spark, str(tmp_path / "shards"), "*.parquet", str(tmp_path / "flat")).first().row_count == 3 and spark.read.parquet(str(tmp_path / "flat")).count() == 3
    assert first_groups(e.withColumn("scale", F.col("src_id")), 2, ["scale"]).count() == 2


def test_build_equals_the_declarative_path(spark):
    from plumbline.operators import trajectory
    from plumbline.plans import catalog, inputs

    sf = "/root/testdata/sf0.01"
    edges = catalog._graphs_built(spark, sf)[0].where("src_id is not null")
    got = edges.where("decision_time = '2024-01-30' and layer_id = 1 and lookback_minutes = 30").toPandas()
    b = inputs.bars(spark, sf).where("available_time <= '2024-01-30'").withColumn("lookback", F.lit(30))
    z = trajectory.standardized(trajectory.median_filled(trajectory.last_values(b, ["close"], ["lookback"]), b.select("symbol").distinct(), ["lookback"]), ["lookback"])
    v = trajectory.vectors(z, ["lookback"]).withColumnRenamed("symbol", "node_id")
    want = graph.degree_cap(graph.reciprocal(graph.directed_topk(v, ["lookback"], 8, 0.1), ["lookback"]), ["lookback"], 6).toPandas()
    assert len(got) > 50
    assert set(zip(got.src_id, got.dst_id, got.weight.round(9))) == set(zip(want.src_id, want.dst_id, want.weight.round(9)))
    degree = pd.concat([edges.toPandas().groupby(["decision_time", "layer_id", "lookback_minutes", c]).size() for c in ("src_id", "dst_id")]).groupby(level=[0, 1, 2, 3]).sum()
    assert degree.max() <= 6


def plain_graph(rows, symbols, time, back, layer, p):
    """{(a, b): weight} of one decision of a one-column layer by plain loops."""
    seen = [r for r in rows if r.available_time <= time and r.timestamp > time - timedelta(days=back)]
    times = sorted({r.timestamp for r in seen})
    if len(times) < layer.minimum_points(back):
        return {}
    value = {(r.symbol, r.timestamp): r.close for r in seen}
    middle = {t: np.median([value[s, t] for s in symbols if (s, t) in value]) for t in times}
    unit = {}
    for s in symbols:
        v = np.array([value.get((s, t), middle[t]) for t in times])
        v = (v - v.mean()) / v.std() if v.std() > 1e-12 else v * 0
        unit[s] = v / np.sqrt((v * v).sum()) if (v * v).sum() > 1e-24 else v
    sims = {(a, b): float(unit[a] @ unit[b]) for a in symbols for b in symbols if a != b}
    near = {a: sorted((b for b in symbols if b != a and sims[a, b] >= p.minimum_similarity), key=lambda b: -sims[a, b])[: p.top_k] for a in symbols}
    degree, out = Counter(), {}
    for a, b in sorted(((a, b) for a in symbols for b in near[a] if a < b and a in near[b]), key=lambda x: -sims[x]):
        if degree[a] < p.degree_cap and degree[b] < p.degree_cap:
            degree.update((a, b))
            out[a, b] = round(sims[a, b], 6)
    return out


def test_build_of_every_decision(spark):
    from plumbline.plans import catalog, inputs

    sf = "/root/testdata/sf0.001"
    rows = inputs.bars(spark, sf).collect()
    symbols, layer = sorted({r.symbol for r in rows}), catalog.BAR_LAYERS[0]
    config = BuildConfig()
    first, last = min(r.available_time for r in rows), max(r.available_time for r in rows)
    want = {}
    for back in layer.lookbacks:
        for n in range((last - first).days + 1):
            time = first + timedelta(days=n)
            want |= {(str(time), back, *ab): w for ab, w in plain_graph(rows, symbols, time, back, layer, config.parameters_for(layer.name, layer.family, back)).items()}
    edges = catalog.QUERIES["graph_build"](spark, sf).toPandas()
    own = edges[edges.layer_id == 1]
    got = {(e.decision_time, e.lookback_minutes, e.src_id, e.dst_id): e.weight for e in own.itertuples()}
    assert set(got) == set(want) and all(abs(got[e] - want[e]) < 2e-6 for e in want)
    assert len({e[0] for e in want}) > 10 and edges.decision_time.nunique() >= len({e[0] for e in want})
    nodes = catalog.QUERIES["graph_build_nodes"](spark, sf).toPandas()
    degree = Counter((e.decision_time, e.layer_id, e.lookback_minutes, n) for e in edges.itertuples() for n in (e.src_id, e.dst_id))
    single = nodes[(nodes.layer_id != 0) & (nodes.degree > 0)]
    assert {(r.decision_time, r.layer_id, r.lookback_minutes, r.node_id): r.degree for r in single.itertuples()} == dict(degree)
    snapshots = catalog.QUERIES["graph_build_snapshots"](spark, sf).toPandas()
    keys = list(zip(snapshots.decision_time, snapshots.layer_id, snapshots.lookback_minutes))
    assert len(keys) == len(set(keys)) >= len({k[:3] for k in degree})
    count = Counter((e.decision_time, e.layer_id, e.lookback_minutes) for e in edges.itertuples())
    assert dict(zip(keys, snapshots.edge_count)) == {k: count.get(k, 0) for k in keys}
    assert (snapshots.universe_count == len(symbols)).all() and np.allclose(snapshots.degree_cap_saturation, snapshots.edge_count / 3000)
    assert set(nodes.columns) >= {"neighbor_reversal", "neighbor_signed_flow", "layer_participation", "scale_role"}
    plain = nodes[nodes.layer_id == 4].iloc[0]
    near = [(n, e.weight) for e in edges.itertuples() if (e.decision_time, e.layer_id, e.lookback_minutes) == (plain.decision_time, 4, plain.lookback_minutes) and plain.node_id in (e.src_id, e.dst_id) for n in ({e.src_id, e.dst_id} - {plain.node_id})]
    time = datetime.fromisoformat(plain.decision_time)
    last_seen = {}
    for r in sorted((r for r in rows if r.available_time <= time and r.timestamp > time - timedelta(days=30)), key=lambda r: r.available_time):
        last_seen[r.symbol] = r.signed_flow
    m, d = np.mean(list(last_seen.values())), np.std(list(last_seen.values()))
    z = {n: (last_seen[n] - m) / d if n in last_seen and d > 1e-12 else 0.0 for n in symbols}
    assert plain.neighbor_signed_flow == pytest.approx(sum(z[n] * w for n, w in near) / sum(w for _, w in near) if near else 0.0, abs=1e-5)


def test_build_does_not_look_ahead(spark):
    """Graphs of one decision from all events and from those available by then are the same."""
    from plumbline.plans import catalog, inputs
    from plumbline.plans.build import build_edges

    b = inputs.bars(spark, "/root/testdata/sf0.001").persist()
    symbols, grid = b.select("symbol", F.col("symbol").alias("symbol_id")).distinct(), pit.decision_grid(b, "1 day")
    build = lambda e: build_edges(e, grid, symbols, BuildConfig(), catalog.BAR_LAYERS, 86400).withColumn("weight", F.round("weight", 9))
    assert build(b).where("decision_time = '2024-01-25'").count() and pit.prefix_difference(build, b, datetime(2024, 1, 25)).count() == 0


def test_build_has_no_bound_on_symbols(spark):
    from plumbline.plans import catalog
    from plumbline.plans.build import build_edges, neighbours

    p = BuildConfig(top_k=3, degree_cap=3).parameters_for("return_corr_raw_1m", "price", 30)
    x = np.random.default_rng(2).standard_normal((500, 8))
    for exact in (True, False):
        a, b = neighbours(x, p, exact), neighbours(x, p, exact, cells=500 * 7)
        assert all(np.allclose(u, v) for u, v in zip(a, b)) and len(a[0])
    symbols = spark.range(20_001).select(F.col("id").alias("symbol_id"), F.col("id").alias("symbol"))
    bar = spark.createDataFrame([(1, T0, minutes(1), 2.0)], "symbol long, timestamp timestamp, available_time timestamp, close double")
    assert "weight" in build_edges(bar, pit.decision_grid(bar, "1 day"), symbols, BuildConfig(), catalog.BAR_LAYERS[:1]).columns


def test_neighbours_by_codes():
    """Every node against the nodes of its code, then those one and two bits away while fewer than top_k + 1 are seen; ties to the smaller."""
    from plumbline.plans.build import best_of_rows, neighbours

    rng = np.random.default_rng(7)
    x = np.repeat(rng.standard_normal((90, 6)), 2, axis=0) + 0.3 * (rng.random((180, 1)) < 0.5) * rng.standard_normal((180, 6))
    p = BuildConfig().parameters_for("x", "y", 5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    bits = graph.lsh_bits(180)
    code = [sum(1 << b for b in range(bits) if u[n] @ graph.lsh_projection(6, bits).astype(float)[:, b] > 0) for n in range(180)]
    want = {}
    for n in range(180):
        rings = [[o for o in range(180) if bin(code[o] ^ code[n]).count("1") <= r] for r in range(3)]
        near = next((m for m in rings if len(m) >= p.top_k + 1), rings[2])
        best = sorted((o for o in near if o != n), key=lambda o: (-round(float(u[n] @ u[o]), 12), o))[: p.top_k]
        want |= {(n, o): k for k, o in enumerate(best, 1) if u[n] @ u[o] >= p.minimum_similarity}
    src, dst, sim, rank = neighbours(x, p, False)
    assert dict(zip(zip(src.tolist(), dst.tolist()), rank.tolist())) == want and np.allclose(sim, (u[src] * u[dst]).sum(1))
    s = rng.integers(0, 4, (40, 30)).astype(float)
    s[rng.random((40, 30)) < 0.2] = -np.inf
    row, column, value, rank = best_of_rows(s, 5)
    order = np.argsort(-s, axis=1, kind="stable")[:, :5]
    assert [(r, c) for r in range(40) for c in order[r] if np.isfinite(s[r, c])] == list(zip(row, column)) and (s[row, column] == value).all()


def test_neighbours_of_copies():
    """Equal rows tie and go to the smaller row, and are searched once: 30,000 rows of 300 vectors cost no 900 million products."""
    from plumbline.plans.build import neighbours

    p = BuildConfig().parameters_for("return_corr_raw_1m", "price", 30)
    few = np.random.default_rng(3).standard_normal((30, 12))
    x = np.tile(few, (20, 1))
    u = few / np.linalg.norm(few, axis=1, keepdims=True)
    for exact in (True, False):
        src, dst, sim, rank = neighbours(x, p, exact)
        for n in (0, 31, 599):
            want = [n % 30 + 30 * i for i in range(p.top_k + 1)]
            assert dst[src == n].tolist() == [m for m in want if m != n][: p.top_k] and rank[src == n].tolist() == list(range(1, p.top_k + 1)) and np.allclose(sim[src == n], 1)
    pairs = np.tile(few[:, :6], (2, 1))
    src, dst, sim, rank = neighbours(pairs, p, True)
    unit = pairs / np.linalg.norm(pairs, axis=1, keepdims=True)
    for n in range(60):
        s = {o: round(float(unit[n] @ unit[o]), 12) for o in range(60) if o != n and unit[n] @ unit[o] >= p.minimum_similarity}
        assert dst[src == n].tolist() == sorted(s, key=lambda o: (-s[o], o))[: p.top_k] and np.allclose(sim[src == n], [s[o] for o in dst[src == n]])
    began = time.process_time()
    assert len(neighbours(np.tile(np.random.default_rng(4).standard_normal((300, 30)), (100, 1)), p, True)[0]) == 30_000 * p.top_k
    assert time.process_time() - began < 3


def test_build_of_many_symbols(spark, monkeypatch):
    """Blocks of a single decision, as large universes have them, and of sixteen give the same graphs."""
    from plumbline.plans import build, catalog

    sf = "/root/testdata/sf0.001"
    whole = catalog.QUERIES["graph_build"](spark, sf).toPandas()
    monkeypatch.setattr(build, "ROWS", 1)
    single = catalog.QUERIES["graph_build"](spark, sf).toPandas()
    order = ["decision_time", "layer_id", "lookback_minutes", "src_id", "dst_id"]
    assert len(whole) and whole.sort_values(order, ignore_index=True).equals(single.sort_values(order, ignore_index=True))


def test_nodes_equal_the_declarative_path(spark):
    """build_nodes beside joins and windows, with a graph without edges; graphs are built once for all that reads them."""
    from plumbline.operators.diagnostics import GROUP
    from plumbline.plans import build, catalog

    graphs, symbols, signals = catalog._graphs_built(spark, "/root/testdata/sf0.001")
    graphs = graphs.where("lookback_minutes <> 5").withColumn("src_id", F.when(F.col("layer_id") * 10 + F.dayofmonth("decision_time") != 30, F.col("src_id"))).persist()
    got = build.build_nodes(graphs, symbols, signals).withColumns({c: F.round(c, 9) for c in ("strength", "core_z", "neighbor_reversal", "neighbor_signed_flow")}).persist()
    edges, nodes, made = graphs.where("src_id is not null"), symbols.select(F.col("symbol_id").cast("long").alias("node_id")), graphs.select(*GROUP).distinct()
    own = graph.node_metrics(edges, nodes, GROUP, made).select(*GROUP, "node_id", "degree", "strength", "core_z")
    whole = graph.multiplex_metrics(edges.where("lookback_minutes = 30"), nodes, made.where("lookback_minutes = 30"))
    whole = whole.select("decision_time", F.lit(0).alias("layer_id"), F.lit(30).alias("lookback_minutes"), "node_id", "degree", "strength", "core_z", "layer_participation")
    pooled = edges.where("lookback_minutes = 30").withColumn("layer_id", F.lit(0))
    means = graph.neighbor_means(edges.unionByName(pooled), signals, GROUP, {"reversal": "neighbor_reversal", "signed_flow": "neighbor_signed_flow"})
    want = own.withColumn("layer_participation", (F.col("degree") > 0).cast("double")).unionByName(whole).join(means, [*GROUP, "node_id"], "left").fillna(0.0)
    both = got.join(want.toDF(*(c if c in (*GROUP, "node_id") else f"_{c}" for c in want.columns)), [*GROUP, "node_id"]).persist()
    assert both.count() == got.count() == want.count() > 1000 and got.where("layer_id = 0").count()
    for c in ("degree", "strength", "core_z", "layer_participation", "neighbor_reversal", "neighbor_signed_flow"):
        assert both.where(F.abs(F.col(c) - F.col(f"_{c}")) > 1e-8).count() == 0, c
    plan = catalog.QUERIES["graph_build_nodes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") >= 2 and "Window [lead(" in plan


def test_snapshots_read_stored_graphs(spark):
    """The graphs are built once, though their keys, nodes and weights all read them."""
    from plumbline.plans import catalog

    plan = catalog.QUERIES["graph_build_snapshots"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("InMemoryRelation") >= 3


def test_signals_of_late_rows(spark):
    """A row counts until the symbol's next one is seen, and again once that one, with an earlier time, has left the window."""
    from plumbline.plans.build import node_signals

    rows = [("a", 0, 1, 5.0), ("a", 3, 3, 7.0), ("a", 1, 4, 9.0), ("b", 0, 1, 1.0)]
    events = spark.createDataFrame([(s, minutes(t), minutes(k), r) for s, t, k, r in rows], "symbol string, timestamp timestamp, available_time timestamp, ret_1m double")
    grid = spark.createDataFrame([(minutes(n),) for n in range(8)], "decision_time timestamp")
    symbols = spark.createDataFrame([(1, "a"), (2, "b")], "symbol_id long, symbol string")
    got = {(r.decision_time, r.node_id): r.reversal for r in node_signals(events, grid, symbols, 4).collect()}
    for n in range(8):
        seen = {s: max(((k, t, r) for x, t, k, r in rows if x == s and k <= n and n - 4 < t), default=None) for s in "ab"}
        value = [seen[s][2] for s in "ab" if seen[s]]
        for i, s in enumerate("ab", 1):
            if value:
                assert got[minutes(n), i] == pytest.approx((np.mean(value) - seen[s][2]) / np.std(value) if seen[s] and np.std(value) else 0.0)
            else:
                assert (minutes(n), i) not in got


def test_market_residual():
    from plumbline.plans.build import market_residual, rolled

    rng = np.random.default_rng(0)
    m = rng.standard_normal(30)
    x = np.vstack([m, 2 * m + 1, -m + 3])
    assert np.abs(market_residual(x, x, [0], 8)).max() < 1e-4
    assert np.allclose(market_residual(x, np.full_like(x, np.nan), [0], 8), x - np.median(x, axis=0))
    assert rolled(x).shape == (3, 26)


def test_config_from_files(tmp_path):
    from plumbline.config import load_config, registry_yaml

    (tmp_path / "c.json").write_text('{"top_k": 8, "degree_cap": 6, "return_corr_benchmarks": ["spy"], "horizons_minutes": [5], "split_csv_path": "s.csv", "graph_parameter_overrides": {"scale:signed_flow:30": {"top_k": 7}}}')
    (tmp_path / "s.csv").write_text("")
    config = load_config(str(tmp_path / "c.json"))
    assert config.parameters_for("signed_flow", "trade_flow", 30).top_k == 7
    assert config.return_corr_benchmarks == ("SPY",) and config.horizons_minutes == (5,) and config.split_csv_path == str(tmp_path / "s.csv")
    assert "scale:signed_flow:30" in registry_yaml("set", [("signed_flow", 30, config.parameters_for("signed_flow", "trade_flow", 30))])
    with pytest.raises(TypeError):
        (tmp_path / "d.json").write_text('{"nope": 1}')
        load_config(str(tmp_path / "d.json"))


def test_command_line(spark, tmp_path):
    from plumbline import api, cli

    rng = np.random.default_rng(8)
    rows = [(f"S{s}", datetime(2024, 1, 2, 14, 30) + timedelta(minutes=t), datetime(2024, 1, 2, 14, 31) + timedelta(minutes=t), "2024-01-02", float(100 + rng.random() + np.cos(t * (1 + s % 12))), float(0.1 * rng.standard_normal() + np.sin(t * (1 + s % 12)))) for s in range(48) for t in range(40)]
    spark.createDataFrame(rows, "symbol string, timestamp timestamp, available_time timestamp, trade_date string, close double, ret_1m double").withColumns({"volume_ofi_proxy": F.col("ret_1m") * 2, "count_ofi_proxy": F.col("ret_1m"), "signed_dollar_flow": F.col("close") - 100}).write.parquet(str(tmp_path / "ev"))
    (tmp_path / "c.json").write_text('{"top_k": 4, "degree_cap": 3, "minimum_similarity": 0.05, "frequency": "5min"}')
    place = ["--events", str(tmp_path / "ev"), "--store", str(tmp_path / "st"), "--date", "2024-01-02", "--config", str(tmp_path / "c.json")]
    cli.main(["build-date", *place])
    store = Store(spark, str(tmp_path / "st"))
    edges = store.read("edges").toPandas()
    assert set(edges.layer_id) == {1, 4, 14} and len(edges) and edges.weight.between(0.05, 1).all() and edges.window_start.notna().all() and set(edges.top_k) == {4}
    nodes = store.read("node_features").toPandas()
    assert store.read("labels").count() and set(nodes.layer_id) == {0, 1, 4, 14} and nodes.neighbor_reversal.abs().sum() > 0 and nodes.neighbor_signed_flow.abs().sum() > 0
    snapshots = store.read("snapshots").toPandas()
    assert set(snapshots.layer_id) == {1, 4, 14} and snapshots.edge_count.sum() == len(edges) and snapshots.weight_p95.notna().all()
    manifest = json.loads((tmp_path / "st/manifest.json").read_text())
    assert manifest["dates"]["2024-01-02"]["edges"] == len(edges) and manifest["universe_count"] == 48
    cli.main(["patch-layers", *place, "--layers", "1,14"])
    assert store.read("edges").count() == len(edges) and store.read("snapshots").count() == len(snapshots)
    manifest = json.loads((tmp_path / "st/manifest.json").read_text())
    assert manifest["multiplex_status"]["layer_id"] == 0 and manifest["patch_history"][0]["merge_stats"]["edges"]["merged_rows"] == len(edges)
    cli.main(["features", "--events", str(tmp_path / "ev"), "--store", str(tmp_path / "st"), "--start", "2024-01-02 14:30:00", "--end", "2024-01-02 15:00:00", "--out", str(tmp_path / "wide"), "--config", str(tmp_path / "c.json")])
    wide = spark.read.parquet(str(tmp_path / "wide"))
    assert wide.count() == 48 * 6 and {"label__5", "feature__close", "feature__graph__signed_flow__degree", "feature__graph__multiplex__core_z"} <= set(wide.columns)
    assert wide.where("label__5 is not null and feature__graph__signed_flow__degree is not null").count() > 48
    batches = api.GraphBatches(store)
    shown = batches.snapshot("2024-01-02", batches.times("2024-01-02")[-1], [4])
    assert {r.layer_id for r in shown["edges"].collect()} == {4} and {r.layer_id for r in shown["node_features"].collect()} == {0, 4}
    assert api.GraphPipeline(ParquetEvents(spark, str(tmp_path / "ev")), store).build_pending() == {}
    assert cli.unreadable(spark, str(tmp_path / "wide")).count() == 0
    cli.main(["discover-themes", "--store", str(tmp_path / "st"), "--themes", str(tmp_path / "th"), "--run", "r"])
    themes = ThemeStore(spark, str(tmp_path / "th"))
    assert themes.read("temporal_edges").count() and themes.read("layer_communities").count()
    n = themes.read("themes").count()
    assert n and themes.read("lifecycle").where("status = 'active'").count() == themes.read("semantics").count() == n
    assert set(themes.read("themes").columns) >= {"theme_quality_score", "quality_breakdown", "theme_path_id", "source_families"} and spark.read.parquet(str(tmp_path / "th/read_models/active_theme_paths")).count()
    (good,) = [p for p in sorted((tmp_path / "wide").glob("*.parquet"))][:1]
    import shutil

    shutil.copytree(tmp_path / "wide", tmp_path / "mirror")
    good.write_bytes(good.read_bytes()[:-20])
    (tmp_path / "wide" / f".{good.name}.crc").unlink()
    assert cli.unreadable(spark, str(tmp_path / "wide")).count() == 1
    assert cli.repair(spark, str(tmp_path / "wide"), str(tmp_path / "mirror")) == [(good.name, True)]
    assert spark.read.parquet(str(tmp_path / "wide")).count() == 48 * 6
