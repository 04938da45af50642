"""Registered queries without SQL, over their whole inputs, beside plain versions or the properties that define them."""

import hashlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from plumbline.operators import communities, graph
from plumbline.plans import catalog, inputs
from tests.test_operators import plain_paths

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def units(spark):
    return [r.asDict() for r in catalog._units(spark, SF).collect()]


def test_capped_edges(spark):
    want = set()
    full = catalog._mutual(spark, SMALL).collect()
    for layer in {r.layer_id for r in full}:
        degree = defaultdict(int)
        for r in sorted((r for r in full if r.layer_id == layer), key=lambda r: (-r.weight, r.src_id, r.dst_id)):
            if max(degree[r.src_id], degree[r.dst_id]) < 3:
                want.add((layer, r.src_id, r.dst_id, round(r.weight, 6)))
                degree[r.src_id] += 1
                degree[r.dst_id] += 1
    assert {(r.layer_id, r.src_id, r.dst_id, r.weight) for r in catalog.QUERIES["capped_edges"](spark, SMALL).collect()} == want


def test_lsh_edges(spark):
    """Nodes look at their own code, then at codes one and two bits away while fewer than nine are seen; the eight most similar, then the threshold."""
    table, rows = graph.lsh_projection(64, 6), defaultdict(dict)
    for r in inputs.vectors(spark, SMALL).collect():
        rows[r.layer_id][r.node_id] = np.array(r.vector)
    want = {}
    for layer, vectors in rows.items():
        code = {n: sum(1 << b for b in range(6) if v @ table[:, b].astype(float) > 0) for n, v in vectors.items()}
        top = {}
        for n, v in vectors.items():
            for reach in range(3):
                near = [m for m in vectors if bin(code[m] ^ code[n]).count("1") <= reach]
                if len(near) >= 9 or reach == 2:
                    break
            sims = sorted(((float(v @ vectors[m] / np.linalg.norm(v) / np.linalg.norm(vectors[m])), m) for m in near if m != n), key=lambda x: (-x[0], x[1]))[:8]
            top[n] = {m: s for s, m in sims if s >= 0.1}
        want |= {(layer, a, b): (s + top[b][a]) / 2 for a in top for b, s in top[a].items() if a < b and a in top[b]}
    got = {(r.layer_id, r.src_id, r.dst_id): r.weight for r in catalog.QUERIES["lsh_edges"](spark, SMALL).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_communities_detected(spark):
    """Top communities are disjoint and connected, and no node gains modularity by joining a neighbour's; parts lie in their parents."""
    edges = defaultdict(list)
    for r in catalog._graphs(spark, SMALL).collect():
        edges[r.layer_id].append((r.src_id, r.dst_id, r.weight))
    found = catalog.QUERIES["communities_detected"](spark, SMALL).collect()
    assert found
    for layer, es in edges.items():
        mine = [r for r in found if r.layer_id == layer]
        parents = {r.community_id: set(r.members) for r in mine if r.parent_id is None}
        nodes = {n for a, b, _ in es for n in (a, b)}
        assert sum(map(len, parents.values())) == len(set().union(*parents.values())) if parents else True
        near = defaultdict(dict)
        for a, b, w in es:
            near[a][b] = near[b][a] = w
        degree = {n: sum(near[n].values()) for n in nodes}
        total = sum(degree.values())
        for members in parents.values():
            seen, todo = set(), [min(members)]
            while todo:
                n = todo.pop()
                if n not in seen:
                    seen.add(n)
                    todo += [m for m in near[n] if m in members]
            assert seen == members and len(members) >= 3
        for r in mine:
            assert r.is_market_mode == (r.parent_id is None and len(r.members) > 0.15 * len(nodes))
            if r.parent_id is not None:
                assert set(r.members) < parents[r.parent_id] and len(parents[r.parent_id]) >= 30
        gain = lambda n, members: sum(w for m, w in near[n].items() if m in members and m != n) - degree[n] * sum(degree[m] for m in members if m != n) / total  # noqa: B023, E731
        for members in parents.values():
            for n in members:
                assert all(gain(n, members) >= gain(n, other) - 1e-9 for other in parents.values() if other is not members and any(m in other for m in near[n]))


def test_consensus_themes(spark):
    found = catalog.QUERIES["consensus_themes"](spark, SF).collect()
    assert len(found) > 100
    pairs, votes = defaultdict(float), defaultdict(set)
    for u in units(spark):
        members, layer = sorted(u["members"]), u["layer_name"].removesuffix("@30m")
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                pairs[str(u["snapshot_time"]), a, b] += 0.5
                votes[str(u["snapshot_time"]), a, b].add(layer)
    family = {"signed_flow": "trade_flow", "price_impact": "liquidity"}
    for r in found:
        inside = [(r.snapshot_time, a, b) for i, a in enumerate(r.members) for b in r.members[i + 1 :] if (r.snapshot_time, a, b) in pairs]
        layers = sorted(set().union(*(votes[p] for p in inside)))
        score = sum(pairs[p] for p in inside) / len(inside)
        assert r.consensus_score == pytest.approx(score) and r.structure_score == pytest.approx(min(1, score * (0.6 + 0.4 * min(1, 8 / len(r.members)))))
        assert r.source_layers == layers and r.source_families == sorted(family[x] for x in layers) and len(layers) == 2
        strong = defaultdict(set)
        for t, a, b in inside:
            if pairs[t, a, b] >= 0.8:
                strong[a].add(b)
                strong[b].add(a)
        seen, todo = set(), [r.members[0]]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += strong[n]
        assert seen == set(r.members) and len(seen) >= 3
        stamp = r.snapshot_time.replace("-", "").replace(" ", "T").replace(":", "")
        assert r.theme_instance_id == f"{stamp}_{hashlib.sha1(','.join(map(str, r.members)).encode()).hexdigest()[:10]}"


def plain_lifecycle(themes):
    """{(time, theme, event): (path, age, overlap, previous)}: each frame against the one before."""
    frames, out, paths = sorted({t["snapshot_time"] for t in themes}), {}, {}
    for k, time in enumerate(frames):
        now = sorted((t for t in themes if t["snapshot_time"] == time), key=lambda t: t["theme_instance_id"])
        before = [t for t in themes if k and t["snapshot_time"] == frames[k - 1]]
        claimed, touched, fresh = set(), set(), {}
        for t in now:
            share = lambda o: len(set(t["members"]) & set(o["members"])) / min(len(t["members"]), len(o["members"]))  # noqa: B023, E731
            matches = sorted((-share(o), o["theme_instance_id"]) for o in before if share(o) >= 0.5)
            name = t["theme_instance_id"]
            touched |= {o for _, o in matches}
            if matches and matches[0][1] not in claimed:
                claimed.add(matches[0][1])
                path, age = paths[matches[0][1]]
                fresh[name] = (path, age + 1)
                event = "continuation" if len(matches) == 1 else "merge"
            else:
                fresh[name] = (name, 1)
                event = "split" if matches else "birth"
            out[time, name, event] = (*fresh[name], -matches[0][0] if matches else 1.0, matches[0][1] if matches else None)
        for o in before:
            if o["theme_instance_id"] not in touched:
                out[time, o["theme_instance_id"], "death"] = (*paths[o["theme_instance_id"]], 0.0, o["theme_instance_id"])
        paths = fresh
    return out


def test_theme_lifecycle_and_latest(spark):
    themes = [r.asDict() for r in catalog.QUERIES["consensus_themes"](spark, SF).select("snapshot_time", "theme_instance_id", "members").collect()]
    want = plain_lifecycle(themes)
    rows = catalog.QUERIES["theme_lifecycle"](spark, SF).collect()
    got = {(r.snapshot_time, r.theme_instance_id, r.event_type): (r.theme_path_id, r.age_frames, r.overlap, r.previous_instance_id) for r in rows}
    assert got.keys() == want.keys() and len(rows) == len(want) > 200
    for k, (path, age, overlap, previous) in want.items():
        assert got[k] == (path, age, pytest.approx(overlap), previous)
    assert all(r.duration_minutes == 1440 * r.age_frames and (r.status == "inactive") == (r.event_type == "death") for r in rows)
    assert {e for _, _, e in want} == {"birth", "death", "continuation", "split", "merge"} or {"birth", "death"} <= {e for _, _, e in want}
    latest = {}
    for (time, name, _), (path, *_) in want.items():
        latest[path] = max(latest.get(path, ("", "")), (time, name))
    assert {r.theme_path_id: (r.snapshot_time, r.theme_instance_id) for r in catalog.QUERIES["theme_latest"](spark, SF).collect()} == latest


def test_lifecycle_of_runs_in_few_jobs(spark):
    """Two runs of themes that share members, over uneven times, equal plain versions; the small job is few of Spark's."""
    rng = np.random.default_rng(5)
    start, rows = datetime(2024, 11, 3, 5), []
    for name, frames in (("x", 9), ("y", 6)):
        for t in np.sort(rng.choice(40, frames, replace=False)).tolist():
            for k in range(int(rng.integers(1, 9))):
                rows.append((name, start + timedelta(minutes=15 * t), f"{name}{t}-{k}", rng.choice(30, int(rng.integers(1, 12)), replace=False).tolist()))
    themes = spark.createDataFrame(rows, "name string, snapshot_time timestamp, theme_instance_id string, members array<long>")
    spark.sparkContext.setJobGroup("lifecycle-jobs", "lifecycle")
    try:
        found = communities.lifecycle(themes, 15, run="name").collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("lifecycle-jobs")) < 20
    got = {(r.snapshot_time, r.theme_instance_id, r.event_type): (r.theme_path_id, r.age_frames, r.overlap, r.previous_instance_id) for r in found}
    want = {}
    for name in "xy":
        want |= plain_lifecycle([{"snapshot_time": t, "theme_instance_id": i, "members": m} for n, t, i, m in rows if n == name])
    assert got.keys() == want.keys() and len(found) == len(want)
    for k, (path, age, overlap, previous) in want.items():
        assert got[k] == (path, age, pytest.approx(overlap), previous)
    assert {e for _, _, e in want} == {"birth", "death", "continuation", "split", "merge"}


def test_theme_latest_in_few_jobs(spark):
    """Where no classes are linked, no job is spent on a graph of members."""
    spark.sparkContext.setJobGroup("latest-jobs", "latest")
    try:
        assert catalog.QUERIES["theme_latest"](spark, SF).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("latest-jobs")) < 33


def test_structural_forest(spark):
    by_time = defaultdict(list)
    for u in units(spark):
        by_time[u["snapshot_time"]].append(u)
    want = set()
    for time, us in by_time.items():
        for k in (0, 1):
            root = set().union(*(set(u["members"]) for u in us if u["layer_name"].startswith("price") and u["community_id"] % 2 == k))
            if len(root) < 20:
                continue
            parts = defaultdict(set)
            for u in us:
                part = tuple(sorted(root & set(u["members"])))
                if 5 <= len(u["members"]) <= 160 and 5 <= len(part) <= min(160, int(len(root) * 0.85)):
                    parts[part].add(u["layer_name"])
            chosen = []
            for part in sorted(parts, key=lambda p: (-len(parts[p]), -len(p), p)):
                if len(chosen) < 12 and all(len(set(part) & set(o)) / len(set(part) | set(o)) <= 0.72 for o in chosen):
                    chosen.append(part)
            if len(chosen) >= 2:
                want |= {(time.strftime("%Y-%m-%d %H:%M:%S"), f"T{k}", n, part, tuple(sorted(parts[part]))) for n, part in enumerate(chosen, 1)}
    got = {(r.snapshot_time, r.theme_instance_id, r.child, tuple(r.members), tuple(r.layers)) for r in catalog.QUERIES["structural_forest"](spark, SF).collect()}
    assert got == want and len(want) > 100


def test_theme_forest(spark):
    """Every graph's members once in coarse leaves of at most 50 and once in fine ones; children partition their parents, and every split is the best of the tried ones."""
    rows = catalog.QUERIES["theme_forest"](spark, SF).toPandas()
    pairs = catalog._pairs(spark, SF).toPandas()
    pairs["decision_time"] = pairs.decision_time.dt.strftime("%Y-%m-%d %H:%M:%S")
    for key, g in rows.groupby(["decision_time", "layer_id"]):
        own = pairs[(pairs.decision_time == key[0]) & (pairs.layer_id == key[1])]
        nodes = set(own.a) | set(own.b)
        member = {t: set(m.member_id.astype(int)) for t, m in g[g.kind == "member"].groupby("theme_id")}
        node = g[g.kind == "node"].set_index("theme_id")
        for level in ("B50", "B35"):
            leaves = node[node.is_leaf.astype(bool) & (node.level == level)]
            assert sorted(x for t in leaves.index for x in member[t]) == sorted(nodes)
            assert all(len(member[t]) == leaves["size"][t] for t in leaves.index) and leaves["size"].max() <= 50
        for parent, kids in node.groupby("parent_theme_id"):
            if parent:
                assert kids["size"].sum() == node["size"][parent]
        inside = {t: member[t] for t in member}

        def members_of(t):
            return inside[t] if t in inside else set().union(*(members_of(k) for k in node.index[(node.parent_theme_id == t) & (node.level == "B50")]))

        weight = {frozenset((a, b)): w for a, b, w in zip(own.a, own.b, own.weight)}
        for parent, kids in g[g.kind == "edge"].groupby("parent_theme_id"):
            level, bound, whole = kids.level.iloc[0], (10 if kids.level.iloc[0] == "B50" else 8), members_of(parent)
            scores = {}
            for k in (5, 3, 2, 1):
                links = set()
                for n in whole:
                    near = sorted(((w, -o) for o in whole if o != n and (w := weight.get(frozenset((n, o)), 0)) > 0), reverse=True)[:k]
                    links |= {frozenset((n, -o)) for _, o in near}
                root = {n: n for n in whole}
                for a, b in links:
                    x, y = a, b
                    while root[x] != x:
                        x = root[x]
                    while root[y] != y:
                        y = root[y]
                    root[max(x, y)] = min(x, y)
                sizes = defaultdict(int)
                for n in whole:
                    while root[n] != n:
                        n = root[n]
                    sizes[n] += 1
                if len(sizes) > 1:
                    tiny = np.mean([s < bound for s in sizes.values()])
                    scores[k] = (2 * (1 - max(sizes.values()) / len(whole)) - 0.5 * tiny + 0.02 * np.log1p(len(sizes)), sorted(sizes.values()))
            mode = kids.split_mode.iloc[0]
            if mode == "passthrough":
                assert level == "B35" and len(whole) <= 35
            elif scores:
                best = max(scores, key=lambda k: (scores[k][0], k))
                assert mode == f"topk_{best}" and sorted(kids["size"]) == scores[best][1]
            else:
                assert mode == "forced_chunk" and all(s <= (50 if level == "B50" else 35) for s in kids["size"])


def test_tracked_paths_and_metrics(spark):
    frames = defaultdict(lambda: defaultdict(list))
    for u in units(spark):
        if len(u["members"]) >= 5:
            frames[u["layer_name"]][u["snapshot_time"]].append(frozenset(u["members"]))
    want = set()
    for layer, by_time in frames.items():
        ordered = [[frozenset(c) for c in sorted(map(sorted, by_time[t]))] for t in sorted(by_time)]
        for arm in catalog.paths.ARMS:
            want |= {(layer, *r) for r in plain_paths(ordered, arm)}
    rows = catalog.QUERIES["tracked_paths"](spark, SF).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) > 100
    groups = defaultdict(list)
    for layer, arm, _, first, last, hits, ok, revivals, held in want:
        if ok:
            groups[layer, arm].append(((last - first) * 5 + 5, hits, revivals > 0, held > 0))
    got = {(r.layer_name, r.arm): r for r in catalog.QUERIES["path_metrics"](spark, SF).collect()}
    assert set(got) == set(groups)
    for key, g in groups.items():
        life, hits, back, held = map(np.array, zip(*g))
        r = got[key]
        assert (r.paths, r.mean_hits, r.median_life, r.s5, r.s15, r.s30, r.s60, r.revival_rate, r.confirmed_revival_rate) == pytest.approx((len(g), hits.mean(), np.median(life), *((life >= n).mean() for n in (5, 15, 30, 60)), back.mean(), held.mean()))


def test_hysteresis_replay(spark):
    """Frame by frame, every layer: what was seen is smoothed; active from 0.6, staying from 0.5, one missing frame bridged."""
    frames = defaultdict(lambda: defaultdict(dict))
    for r in inputs.edges(spark, SMALL).collect():
        frames[r.layer_id][r.decision_time][r.src_id, r.dst_id] = r.weight
    want = set()
    for layer, by_time in frames.items():
        smooth, on, away = {}, set(), {}
        for time in sorted(by_time):
            now = by_time[time]
            for e in [e for e in smooth if e not in now]:
                away[e] = away.get(e, 0) + 1
                if e in on and away[e] <= 1:
                    want.add((str(time), layer, *e, round(smooth[e], 6), None, "grace"))
                    on = on if smooth[e] >= 0.5 else on - {e}
                else:
                    del smooth[e]
                    on -= {e}
            for e, w in now.items():
                away.pop(e, None)
                smooth[e] = 0.6 * w + 0.4 * smooth[e] if e in smooth else w
                on = on | {e} if smooth[e] >= (0.5 if e in on else 0.6) else on - {e}
                if e in on:
                    want.add((str(time), layer, *e, round(smooth[e], 6), w, "active"))
    got = {(r.decision_time, r.layer_id, r.src_id, r.dst_id, r.weight, r.raw_weight, r.temporal_status) for r in catalog.QUERIES["hysteresis_replay"](spark, SMALL).collect()}
    assert {k[:4] + k[5:] for k in got} == {k[:4] + k[5:] for k in want}
    weights = {k[:4]: k[4] for k in want}
    assert all(abs(weights[k[:4]] - k[4]) < 2e-6 for k in got)


def test_arm_summary_and_recommended(spark):
    days = {t + timedelta(0) for t in (u["snapshot_time"] for u in units(spark))}
    summary = catalog.QUERIES["arm_summary"](spark, SF).collect()
    assert summary and all(r.days <= len(days) for r in summary)
    best = {}
    for r in summary:
        best.setdefault(r.layer_name, []).append((-(r.score if r.score is not None else float("-inf")), r.arm))
    assert {r.layer_name: r.arm for r in catalog.QUERIES["recommended_arms"](spark, SF).collect()} == {k: min(v)[1] for k, v in best.items()}
