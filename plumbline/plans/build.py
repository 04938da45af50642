"""The graph build: events to edges, node features and snapshot QA of all layer-scales and decisions, as one plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import LAYERS, SCALE_ROLES, BuildConfig, GraphParameters, Layer
from ..operators import graph
from ..operators.diagnostics import GROUP
from ..operators.trajectory import cross_zscore

#: Decision steps of a block, whose decisions share one copy of the events that they see.
BLOCK = 16
#: Symbol-steps that a block's windows may span, and steps of a symbol that travel as one row.
ROWS, SPAN = 1_000_000, 8

EDGE_ROWS = (
    "layer_id int, lookback_minutes int, decision_step_minutes int, top_k int, degree_cap int, minimum_similarity float, window_start timestamp, window_end timestamp, src_id long, dst_id long, weight double, "
    "src_rank int, dst_rank int, directed boolean, lag_bars int, window_points int, vector_dimension int"
)
#: What all rows of a graph share besides its key.
COMMON = ["scale_role", "decision_step_minutes", "top_k", "degree_cap", "minimum_similarity", "window_start", "window_end", "window_points", "vector_dimension"]


class Pivot:
    """Events of a task in order of availability, of which decisions take symbols x timestamps matrices.

    at, known: microseconds; row: the symbol's place; values: a column a feature. Of equal (symbol, timestamp) the last
    available non-null value counts.
    """

    def __init__(self, row: np.ndarray, at: np.ndarray, known: np.ndarray, values: np.ndarray, symbols: int):
        order = np.argsort(known, kind="stable")
        self.known, self.symbols = known[order], symbols
        self.times, column = np.unique(at, return_inverse=True)
        self.row, self.column, self.values = row[order].astype(np.int32), column[order].astype(np.int32), values[order]

    def last(self, feature: int, now: int) -> tuple[np.ndarray, np.ndarray]:
        """(timestamps, symbols x timestamps) of what is known by now of timestamps up to now."""
        seen, width = np.searchsorted(self.known, now, "right"), np.searchsorted(self.times, now, "right")
        value = self.values[:seen, feature]
        some = np.isfinite(value) & (self.column[:seen] < width)
        out = np.full((self.symbols, width), np.nan)
        out[self.row[:seen][some], self.column[:seen][some]] = value[some]
        return self.times[:width], out


def filled(x: np.ndarray) -> np.ndarray:
    """Missing values take their timestamp's median over symbols."""
    return np.where(np.isfinite(x), x, np.nan_to_num(np.nanmedian(x, axis=0)))


def row_standardized(x: np.ndarray) -> np.ndarray:
    s = x.std(axis=1, keepdims=True)
    return np.where(s > 1e-12, (x - x.mean(axis=1, keepdims=True)) / np.where(s > 1e-12, s, 1), 0.0)


def rolled(x: np.ndarray, frame: int = 5) -> np.ndarray:
    """Sums of the last `frame` values, missing if one is; columns without any sum go."""
    if x.shape[1] < frame:
        return x[:, :0]
    out = np.lib.stride_tricks.sliding_window_view(x, frame, axis=1).sum(axis=2)
    return out[:, np.isfinite(out).any(axis=0)]


def market_residual(x: np.ndarray, raw: np.ndarray, benchmarks: list[int], least: int, ridge: float = 1e-6) -> np.ndarray:
    """x less its ridge regression on the benchmarks' rows (intercept free); less its median over symbols if none is usable.

    A benchmark needs `least` values and a deviation above 1e-12.
    """
    usable = [b for b in benchmarks if np.isfinite(raw[b]).sum() >= least and x[b].std() > 1e-12]
    if not usable:
        return x - np.median(x, axis=0)
    design = np.vstack([np.ones(x.shape[1]), x[usable]]).T
    penalty = ridge * np.eye(design.shape[1])
    penalty[0, 0] = 0
    return x - (design @ np.linalg.solve(design.T @ design + penalty, design.T @ x.T)).T


def layer_vectors(raws: list[np.ndarray], transform: str, least: int, benchmarks: list[int] = (), benchmark_points: int = 8, ridge: float = 1e-6) -> tuple[np.ndarray, int] | None:
    """(symbols x features, points): each column's standardised trajectory; a column of fewer than `least` points is skipped, None if all are.

    raws: symbols x timestamps of each column; timestamps without any value go.
    """
    blocks, points = [], 0
    for raw in raws:
        raw = raw[:, np.isfinite(raw).any(axis=0)]
        if transform.endswith("rolling_5m"):
            raw = rolled(raw)
        if raw.shape[1] < least:
            continue
        x = filled(raw)
        if transform.endswith("market_residual"):
            x = market_residual(x, raw, list(benchmarks), benchmark_points, ridge)
        elif "cross_sectional" in transform:
            x = x - np.median(x, axis=0)
        blocks.append(row_standardized(x))
        points = max(points, x.shape[1])
    return (np.hstack(blocks), points) if blocks else None


def best_of_rows(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value, rank from 1) of the k greatest finite values of each row, ties by the smaller column."""
    if s.shape[1] > k:
        last = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        row, column = np.nonzero((s >= last[:, None]) & np.isfinite(s))
    else:
        row, column = np.nonzero(np.isfinite(s))
    value = s[row, column]
    order = np.lexsort((column, -value, row))
    row, column, value = row[order], column[order], value[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    return row[keep], column[keep], value[keep], rank[keep] + 1


def code_groups(code: np.ndarray, size: np.ndarray, bits: int, top_k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, candidates) of each LSH code: its vectors, and those of equal code, then of codes one and two bits away while fewer than top_k + 1 nodes are found. size: a vector's nodes."""
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange((1 << bits) + 1))
    members = [order[i:j] for i, j in zip(starts, starts[1:])]
    nodes = np.bincount(code, size, 1 << bits)
    one = [1 << b for b in range(bits)]
    rings = [[0], one, [x | y for i, x in enumerate(one) for y in one[i + 1 :]]]
    for c in np.flatnonzero(np.diff(starts)):
        near: list[np.ndarray] = []
        found = 0
        for ring in rings:
            near += [members[c ^ mask] for mask in ring]
            found += sum(nodes[c ^ mask] for mask in ring)
            if found >= top_k + 1:
                break
        yield members[c], np.sort(np.concatenate(near))


def contenders(v: np.ndarray, mine: np.ndarray, near: np.ndarray, k: int, least: float, block: int, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, column) of v: for each of mine those of near whose product with it may be among its k greatest, none surely below least.

    v: unit vectors in 32 bits. Products are made `block` columns at a time and held for `cells` at most; what lies below a
    row's k-th greatest so far, by more than 32 bits can err, is left out at once.
    """
    slack = np.float32((v.shape[1] + 4) * 2.0**-22)
    wide = max(1, min(block, len(near), cells))
    step = max(1, cells // wide)
    right = np.ascontiguousarray(v[near].T)
    for start in range(0, len(mine), step):
        rows = mine[start : start + step]
        left, bound = v[rows], np.full(len(rows), np.float32(least) - slack, np.float32)
        row, column, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        done = 0
        while done < len(near):
            end = min(len(near), max(wide, 4 * done))
            parts = [(row, column, value)]
            for at in range(done, end, wide):
                s = left @ right[:, at : min(at + wide, end)]
                if not done and s.shape[1] > k:
                    np.maximum(bound, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack, out=bound)
                hit = np.flatnonzero(s >= bound[:, None])
                parts.append((hit // s.shape[1], hit % s.shape[1] + at, s.ravel()[hit]))
            row, column, value = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((-value, row))
            row, column, value = row[order], column[order], value[order]
            last = np.arange(len(row)) - np.searchsorted(row, row) == k - 1
            bound[row[last]] = np.maximum(bound[row[last]], value[last] - slack)
            keep = value >= bound[row]
            row, column, value = row[keep], column[keep], value[keep]
            done = end
        yield rows[row], near[column]


def ranked(row: np.ndarray, column: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value, rank from 0) in order of row, falling value and column."""
    order = np.lexsort((column, -value, row))
    row, column, value = row[order], column[order], value[order]
    return row, column, value, np.arange(len(row)) - np.searchsorted(row, row)


def neighbours(x: np.ndarray, p: GraphParameters, exact: bool, block: int = 2048, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, similarity, rank) of each row's top_k: exact from the threshold up, else among near LSH codes and then cut at the threshold.

    Equal rows are searched once: of any vector's rows, no row needs more than the top_k + 1 smallest. Vectors are screened
    in 32 bits; those that may be among the best are compared in 64, so that equal pairs tie and go to the smaller row.
    """
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    u = np.ascontiguousarray(np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12) + 0.0)
    n, k = len(u), p.top_k
    if not n or not u.shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    _, first, of, size = np.unique(u.view(np.dtype((np.void, u.dtype.itemsize * u.shape[1]))).ravel(), return_index=True, return_inverse=True, return_counts=True)
    u, member = u[first], np.argsort(of, kind="stable")
    begin = np.cumsum(size) - size
    if exact:
        groups = [(np.arange(len(u)), np.arange(len(u)))]
    else:
        bits = graph.lsh_bits(n)
        groups = code_groups(((u @ graph.lsh_projection(u.shape[1], bits).astype(float) > 0) << np.arange(bits)).sum(1), size, bits, k)
    short = u.astype(np.float32)
    found = [pair for rows, near in groups for pair in contenders(short, rows, near, k + 1, p.minimum_similarity, block, cells)]
    row, column = (np.concatenate(c) for c in zip(*found))
    sim = np.concatenate([np.einsum("ij,ij->i", u[row[i : i + 100_000]], u[column[i : i + 100_000]]) for i in range(0, len(row), 100_000)] or [np.zeros(0)])
    keep = sim >= p.minimum_similarity
    row, column, sim = row[keep], column[keep], sim[keep]
    many = np.minimum(size[column], k + 1)
    at = np.repeat(np.arange(len(row)), many)
    row, dst, sim, rank = ranked(row[at], member[begin[column[at]] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)], sim[at])
    row, dst, sim = row[rank <= k], dst[rank <= k], sim[rank <= k]
    starts = np.searchsorted(row, np.arange(len(u) + 1))
    many = np.diff(starts)[of]
    src = np.repeat(np.arange(n), many)
    at = starts[of[src]] + np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many)
    other = dst[at] != src
    src, at = src[other], at[other]
    rank = np.arange(len(src)) - np.searchsorted(src, src) + 1
    return src[rank <= k], dst[at[rank <= k]], sim[at[rank <= k]], rank[rank <= k]


def mutual_edges(x: np.ndarray, symbols: np.ndarray, p: GraphParameters, exact: bool) -> pd.DataFrame:
    src, dst, sim, rank = neighbours(x, p, exact)
    n = len(x)
    key = src * n + dst
    order = np.argsort(key)
    back = np.searchsorted(key[order], dst * n + src)
    back = np.minimum(back, max(len(key) - 1, 0))
    found = (src < dst) & (key[order][back] == dst * n + src) if len(key) else np.zeros(0, bool)
    other = order[back][found] if len(key) else np.zeros(0, int)
    edges = pd.DataFrame({"src_id": symbols[src[found]], "dst_id": symbols[dst[found]], "weight": (sim[found] + sim[other]) / 2, "src_rank": rank[found].astype(np.int32), "dst_rank": rank[other].astype(np.int32)})
    return graph.capped(edges, p.degree_cap)


def build_graphs(events: DataFrame, decisions: DataFrame, symbols: DataFrame, config: BuildConfig, layers: tuple[Layer, ...] = LAYERS, unit_seconds: int = 60) -> DataFrame:
    """Edges of every decision, layer and lookback: (decision_time, EDGE_ROWS); a graph without edges is one row with null src_id.

    A symbol's events of SPAN steps travel as one row of arrays to each block of decisions that sees some of them, once a
    layer with the layer's columns, and a (block, layer) is one task, which cuts the windows of its decisions itself. A block
    has up to BLOCK decision steps, fewer if the symbols are so many that it would hold more than ROWS symbol-steps. Its
    memory grows with the symbols, its time with the square of those that differ. The universe (symbol_id, symbol), and with
    it the configuration's benchmarks, travels with the task. Layers without one of their columns are skipped.
    """
    known = symbols.orderBy("symbol_id").collect()
    ids = np.array([r.symbol_id for r in known], np.int64)
    marks = [n for n, r in enumerate(known) if str(r.symbol) in config.return_corr_benchmarks]
    usable = {x.layer_id: x for x in layers if set(x.columns) <= set(events.columns)}
    longest = max((back for x in usable.values() for back in x.lookbacks), default=0)
    width = unit_seconds * min(BLOCK, max(1, ROWS // max(1, len(known)) - longest))
    span = SPAN * unit_seconds
    block = lambda seconds: F.floor(seconds / width)
    due = decisions.select("decision_time", block(F.unix_seconds("decision_time")).alias("_block")).groupBy("_block").agg(F.array_sort(F.collect_set(F.unix_micros("decision_time"))).alias("_times"))
    rows = events.join(symbols, "symbol").select("symbol_id", F.floor(F.unix_seconds("timestamp") / span).alias("_span"), F.struct(
        F.unix_micros("timestamp").alias("at"), F.unix_micros("available_time").alias("known"), *(F.col(c).cast("double").alias(c) for c in sorted({c for x in usable.values() for c in x.columns})),
    ).alias("e")).groupBy("symbol_id", "_span").agg(F.collect_list("e").alias("e"))
    part = lambda x: F.struct(F.lit(x.layer_id).alias("layer_id"), F.flatten(F.transform("e", lambda e: F.array(*(e[c] for c in x.columns)))).alias("v"))
    shaped = rows.select("symbol_id", "_span", F.col("e.at").alias("at"), F.col("e.known").alias("known"), F.explode(F.array(*map(part, usable.values()))).alias("x")).select("symbol_id", "_span", "at", "known", "x.*")
    long = shaped.withColumn("_block", F.explode(F.sequence(block(F.col("_span") * span), block((F.col("_span") + 1) * span - 1 + longest * unit_seconds)))).drop("_span").join(due, "_block")
    names = [x.split()[0] for x in ("decision_time long, " + EDGE_ROWS).split(", ")]
    # times travel as microseconds, whatever the session's time zone
    schema = T.StructType.fromDDL("decision_time long, " + EDGE_ROWS.replace(" timestamp", " long"))
    shape = to_arrow_schema(schema)

    def graphs(layer: Layer, pivot: Pivot, now: int) -> Iterator[pa.Table]:
        seen = [pivot.last(n, now) for n in range(len(layer.columns))]
        for back in layer.lookbacks:
            start = now - back * unit_seconds * 1_000_000
            raws = [x[:, np.searchsorted(times, start, "right") :] for times, x in seen]
            got = layer_vectors(raws, layer.transform, layer.minimum_points(back), marks, config.return_corr_min_benchmark_points, config.return_corr_ridge)
            if got is None:
                continue
            x, points = got
            p = config.parameters_for(layer.name, layer.family, back)
            edges = mutual_edges(x, ids, p, layer.transform.startswith("return_corr_"))
            edges = edges if len(edges) else pd.DataFrame({c: [None] for c in edges.columns})
            found = edges.assign(
                decision_time=now, layer_id=layer.layer_id, lookback_minutes=back, decision_step_minutes=1, top_k=p.top_k, degree_cap=p.degree_cap, minimum_similarity=p.minimum_similarity,
                window_start=start, window_end=now, directed=layer.directed, lag_bars=layer.lag_bars, window_points=points, vector_dimension=x.shape[1],
            )
            yield pa.Table.from_pandas(found[names], shape, preserve_index=False)

    def build(t: pa.Table) -> pa.Table:
        layer = usable[t["layer_id"][0].as_py()]
        at = t["at"].combine_chunks()
        row = np.repeat(np.searchsorted(ids, t["symbol_id"].to_numpy()), at.value_lengths().to_numpy())
        values = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(layer.columns))
        pivot = Pivot(row, at.flatten().to_numpy(), t["known"].combine_chunks().flatten().to_numpy(), values, len(ids))
        return pa.concat_tables([shape.empty_table(), *(g for now in t["_times"][0].as_py() for g in graphs(layer, pivot, now))])

    # a task a group: AQE would join small partitions, whose bytes say little about their work
    groups = max(due.count() * len(usable), int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = long.repartition(groups, "_block", "layer_id").groupBy("_block", "layer_id").applyInArrow(build, schema)
    role = F.coalesce(F.create_map(*(F.lit(x) for kv in SCALE_ROLES.items() for x in kv))[F.col("lookback_minutes")], F.lit(""))
    return made.withColumns({c: F.timestamp_micros(c) for c in ("decision_time", "window_start", "window_end")}).withColumn("scale_role", role)


def build_edges(events: DataFrame, decisions: DataFrame, symbols: DataFrame, config: BuildConfig, layers: tuple[Layer, ...] = LAYERS, unit_seconds: int = 60) -> DataFrame:
    """The edges of build_graphs alone."""
    return build_graphs(events, decisions, symbols, config, layers, unit_seconds).where("src_id is not null")


def node_signals(events: DataFrame, decisions: DataFrame, symbols: DataFrame, lookback: int, unit_seconds: int = 60) -> DataFrame:
    """(decision_time, node_id, reversal, signed_flow): each symbol's last visible row of the longest window, as z-scores over the universe.

    reversal is the negative z of ret_1m (or log_ret_1m), signed_flow that of signed_dollar_flow (or its proxy); a column that events lack gives 0.
    A row goes to the decisions from which it is seen until the symbol's next row is, unless that one leaves the window first.
    """
    pick = lambda *names: next((F.col(c).cast("double") for c in names if c in events.columns), F.lit(None).cast("double"))
    first = F.ceil(F.unix_seconds("timestamp") / unit_seconds)
    rows = events.select(
        "symbol", "timestamp", "available_time", pick("ret_1m", "log_ret_1m").alias("r"), pick("signed_dollar_flow", "signed_dollar_flow_proxy").alias("f"),
        F.greatest(first, F.ceil(F.unix_micros("available_time") / (unit_seconds * 1_000_000))).alias("_from"), (first + lookback - 1).alias("_to"),
    )
    w = Window.partitionBy("symbol").orderBy("available_time", "timestamp")
    rows = rows.withColumns({"_next": F.lead("_from").over(w), "_last": F.lead("_to").over(w)})
    rows = rows.withColumn("_to", F.when(F.col("_last") >= F.col("_to"), F.least("_to", F.col("_next") - 1)).otherwise(F.col("_to"))).where("_from <= _to")
    seen = rows.withColumn("decision_time", F.explode(F.sequence("_from", "_to"))).withColumn("decision_time", F.timestamp_seconds(F.col("decision_time") * unit_seconds)).join(decisions, "decision_time", "left_semi")
    last = seen.groupBy("decision_time", "symbol").agg(F.max_by(F.struct("r", "f"), F.struct("available_time", "timestamp")).alias("x"))
    universe = symbols.select(F.col("symbol_id").cast("long").alias("node_id"), "symbol")
    every = last.select("decision_time").distinct().crossJoin(universe).join(last, ["decision_time", "symbol"], "left").select("decision_time", "node_id", F.col("x.r").alias("r"), F.col("x.f").alias("f"))
    z = cross_zscore(every, "r", ["decision_time"]).withColumnRenamed("z", "_r")
    z = cross_zscore(z, "f", ["decision_time"])
    return z.select("decision_time", "node_id", (-F.col("_r")).alias("reversal"), F.col("z").alias("signed_flow"))


NODE_ROWS = "layer_id int, lookback_minutes int, node_id long, degree long, strength double, core_z double, layer_participation double, scale_role string, decision_step_minutes int, top_k int, degree_cap int, minimum_similarity float"


def build_nodes(graphs: DataFrame, symbols: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Node features of every graph, those without edges too, and of the multiplex of its structural layers as layer 0.

    The multiplex averages over the structural (30 minute) graphs of a time, each of them once, with edges or without.
    signals: node_signals; their weighted means over neighbours are neighbor_reversal and neighbor_signed_flow. A time's
    edges are one task, and only they and the signals travel. graphs is read twice: store it first.
    """
    ids = np.sort(symbols.select("symbol_id").toArrow()["symbol_id"].to_numpy()).astype(np.int64)
    how = ["scale_role", "decision_step_minutes", "top_k", "degree_cap", "minimum_similarity"]
    key = ["layer_id", "lookback_minutes"]
    at = F.unix_micros("decision_time").alias("at")
    made = graphs.select(*GROUP, *how).distinct().select(at, *key, F.lit(None).cast("long").alias("src_id"), F.lit(None).cast("long").alias("dst_id"), F.lit(None).cast("double").alias("weight"), F.struct(*how).alias("how"))
    rows = graphs.where("src_id is not null").select(at, *key, "src_id", "dst_id", "weight", F.lit(None).cast(made.schema["how"].dataType).alias("how")).unionByName(made)
    names = [] if signals is None else ["reversal", "signed_flow"]
    schema = T.StructType.fromDDL("at long, " + NODE_ROWS + "".join(f", neighbor_{c} double" for c in names))
    shape = to_arrow_schema(schema)
    n = len(ids)

    def features(now: int, layer: int, back: int, said: dict, degree: np.ndarray, strength: np.ndarray, part: np.ndarray, sums: list[np.ndarray], weight: np.ndarray) -> pa.Table:
        z = strength - strength.mean()
        deviation = np.sqrt((z * z).mean())
        core = z / deviation if deviation > 1e-12 else np.zeros(n)
        means = [np.divide(x, weight, out=np.zeros(n), where=np.abs(weight) > 0) for x in sums]
        same = lambda v, c: pa.repeat(pa.scalar(v, shape.field(c).type), n)
        return pa.Table.from_arrays([same(now, "at"), same(layer, "layer_id"), same(back, "lookback_minutes"), *map(pa.array, (ids, degree, strength, core, part)), *(same(said[c], c) for c in how), *map(pa.array, means)], schema=shape)

    def build(t: pa.Table, s: pa.Table | None = None) -> pa.Table:
        out = [shape.empty_table()]
        if not t.num_rows:
            return out[0]
        signal = [np.zeros(n) for _ in names]
        if s is not None and s.num_rows:
            place = np.searchsorted(ids, s["node_id"].to_numpy())
            for x, c in zip(signal, names):
                x[place] = np.nan_to_num(s[c].to_numpy())
        own = t["how"].is_valid()
        found = sorted(t.filter(own).select(["at", *key, "how"]).to_pylist(), key=lambda r: (r["layer_id"], r["lookback_minutes"]))
        t = t.filter(pc.invert(own))
        code = t["layer_id"].to_numpy().astype(np.int64) << 32 | t["lookback_minutes"].to_numpy()
        order = np.argsort(code, kind="stable")
        code = code[order]
        a, b = (np.searchsorted(ids, t[c].to_numpy())[order] for c in ("src_id", "dst_id"))
        w, now = t["weight"].to_numpy()[order], None
        pooled, layers = [np.zeros(0, np.int64)], set()
        whole = [np.zeros(n), np.zeros(n), [np.zeros(n) for _ in names]]
        for g in found:
            now = g["at"]
            name = g["layer_id"] << 32 | g["lookback_minutes"]
            i, j = np.searchsorted(code, (name, name + 1))
            x, y, v = a[i:j], b[i:j], w[i:j]
            both = np.concatenate([x, y])
            degree, strength = np.bincount(both, minlength=n), np.bincount(both, np.concatenate([v, v]), n)
            sums = [np.bincount(x, v * c[y], n) + np.bincount(y, v * c[x], n) for c in signal]
            some = (degree > 0).astype(float)
            out.append(features(now, g["layer_id"], g["lookback_minutes"], g["how"], degree, strength, some, sums, strength))
            if g["lookback_minutes"] == 30:
                layers.add(g["layer_id"])
                pooled.append(np.minimum(x, y) * n + np.maximum(x, y))
                whole = [whole[0] + strength, whole[1] + some, [p + q for p, q in zip(whole[2], sums)]]
        if layers:
            pairs = np.unique(np.concatenate(pooled))
            degree = np.bincount(pairs // n, minlength=n) + np.bincount(pairs % n, minlength=n)
            said = {"scale_role": "structural", "decision_step_minutes": 5, "top_k": 0, "degree_cap": 0, "minimum_similarity": float("nan")}
            out.append(features(now, 0, 30, said, degree, whole[0] / len(layers), whole[1] / len(layers), whole[2], whole[0]))
        return pa.concat_tables(out)

    grouped = rows.groupBy("at")
    if signals is None:
        out = grouped.applyInArrow(lambda t: build(t), schema)
    else:
        out = grouped.cogroup(signals.select(at, "node_id", *names).groupBy("at")).applyInArrow(lambda t, s: build(t, s), schema)
    return out.select(F.timestamp_micros("at").alias("decision_time"), *(c for c in out.columns if c != "at"))


def build_snapshots(graphs: DataFrame, nodes: DataFrame, universe: int, layers: tuple[Layer, ...] = LAYERS) -> DataFrame:
    """A row a graph: universe, active nodes, coverage, isolation, edges, cap saturation, mean degree and strength, the weights' diagnostics, and how it was made."""
    made = graphs.select(*GROUP, *COMMON).distinct()
    qa = graph.snapshot_qa(nodes.where("layer_id <> 0").drop(*COMMON), GROUP, 1).drop("degree_cap_saturation")
    weights = graph.weight_diagnostics(graphs.where("src_id is not null"), GROUP)
    table = [(x.layer_id, ",".join(x.columns), x.transform, 0 if x.transform.startswith("return_corr_") else graph.lsh_bits(universe)) for x in layers]
    names = graphs.sparkSession.createDataFrame(table, "layer_id int, used_columns string, transform string, lsh_bits int")
    out = made.join(qa, GROUP).join(weights, GROUP, "left").join(names, "layer_id")
    return out.withColumn("degree_cap_saturation", F.col("edge_count") / F.greatest(F.lit(1.0), F.lit(universe) * F.col("degree_cap") / 2.0))
