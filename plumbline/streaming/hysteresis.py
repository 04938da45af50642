"""Hysteresis replay of edges over frames: in batch, and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEY = ["layer_id", "lookback_minutes"]
OUT = "decision_time timestamp, layer_id int, lookback_minutes int, src_id long, dst_id long, weight double, raw_weight double, temporal_status string"


@dataclass(frozen=True)
class Hysteresis:
    """Smoothing of weights, thresholds to enter and to stay, and the frames an active edge may miss."""

    alpha: float = 0.6
    enter: float = 0.75
    leave: float = 0.65
    grace: int = 1

    def step(self, state: dict[tuple, tuple[float, bool, int]], edges: dict[tuple, float]) -> tuple[dict, list[tuple]]:
        """One frame: (new state, (edge, weight, raw weight, status) of active and grace edges).

        A seen edge is smoothed with its state and always stays in it; it is active at `enter`, or `leave` if it was
        active. A missing edge keeps its weight and stays while it was active and has missed no more than `grace` frames.
        """
        new, out = {}, []
        for edge, raw in edges.items():
            old = state.get(edge)
            weight = raw if old is None else self.alpha * raw + (1 - self.alpha) * old[0]
            active = weight >= (self.leave if old and old[1] else self.enter)
            new[edge] = (weight, active, 0)
            if active:
                out.append((edge, weight, raw, "active"))
        for edge, (weight, active, missed) in state.items():
            if edge not in edges and active and missed + 1 <= self.grace:
                new[edge] = (weight, weight >= self.leave, missed + 1)
                out.append((edge, weight, None, "grace"))
        return new, out


def replay(edges: DataFrame, config: Hysteresis = Hysteresis(), frames: DataFrame | None = None) -> DataFrame:
    """OUT rows of the whole history. An edge's state depends on its own weights and on its key's frames, so each edge is a row.

    frames: (KEY, decision_time) of all frames, empty ones too; None: those that have edges. Frames are numbered, an edge
    carries the numbers of its own, and numbers become times again in what comes out: an active edge's missing frames
    are the at most `grace` numbers that follow. No frame's edges meet in one task, no edge sees a list of frames, and
    the result does not depend on how the history is cut.
    """
    times = (edges if frames is None else frames).select(*KEY, F.col("decision_time").cast("timestamp").alias("decision_time")).distinct()
    numbers = times.withColumn("_f", F.row_number().over(Window.partitionBy(*KEY).orderBy("decision_time")))
    last = numbers.groupBy(*KEY).agg(F.max("_f").alias("_end"))
    weight = F.col("weight").cast("double")
    rows = edges.withColumn("decision_time", F.col("decision_time").cast("timestamp")).join(numbers, [*KEY, "decision_time"])
    one = rows.groupBy(*KEY, "src_id", "dst_id").agg(F.array_sort(F.collect_list(F.struct("_f", weight.alias("w")))).alias("_seen")).join(last, KEY)
    columns = ["_f", *KEY, "src_id", "dst_id", "weight", "raw_weight", "temporal_status"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for layer, back, src, dst, at, weights, end in zip(*(batch[c] for c in (*KEY, "src_id", "dst_id", "_at", "_w", "_end"))):
                seen = dict(zip(at.tolist(), weights.tolist()))
                state: dict = {}
                following = [*list(seen)[1:], end + 1]
                for (f, w), stop in zip(seen.items(), following):
                    state, rows = config.step(state, {0: w})
                    found = [(f, r) for r in rows]
                    for missing in range(f + 1, stop):
                        state, rows = config.step(state, {})
                        found += [(missing, r) for r in rows]
                        if not state:
                            break
                    out += [(n, layer, back, src, dst, w, raw, status) for n, (_, w, raw, status) in found]
            yield pd.DataFrame(out, columns=columns).astype({"raw_weight": float})

    on = one.select(F.col("layer_id").cast("int"), F.col("lookback_minutes").cast("int"), F.col("src_id").cast("long"), F.col("dst_id").cast("long"), F.col("_seen._f").alias("_at"), F.col("_seen.w").alias("_w"), "_end")
    found = on.mapInPandas(walk, "_f int, " + OUT.split(", ", 1)[1])
    named = numbers.select(F.col("layer_id").cast("int").alias("layer_id"), F.col("lookback_minutes").cast("int").alias("lookback_minutes"), "_f", "decision_time")
    return found.join(named, [*KEY, "_f"]).select("decision_time", *columns[1:])


STATE = "src array<long>, dst array<long>, weight array<double>, active array<boolean>, missed array<int>"


def replay_stream(edges: DataFrame, config: Hysteresis = Hysteresis()) -> DataFrame:
    """The same as a stream: state is a key's edges; each frame of a key must arrive whole, in one micro-batch, in order.

    An empty frame is a row with null src_id, since absence must be seen to be counted.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {}
        if state.exists:
            held = {(s, d): (w, a, m) for s, d, w, a, m in zip(*state.get)}
        for time, frame in pd.concat(list(batches)).groupby("decision_time", sort=True):
            real = frame.dropna(subset=["src_id"])
            held, out = config.step(held, dict(zip(zip(real["src_id"].astype(int), real["dst_id"].astype(int)), real["weight"])))
            yield pd.DataFrame([(time, *key, *edge, w, raw, status) for edge, w, raw, status in out], columns=[x.split()[0] for x in OUT.split(", ")]).astype({"decision_time": "datetime64[ns]", "raw_weight": float})
        state.update(([s for s, _ in held], [d for _, d in held], [v[0] for v in held.values()], [bool(v[1]) for v in held.values()], [v[2] for v in held.values()]))

    typed = edges.select("decision_time", F.col("layer_id").cast("int").alias("layer_id"), F.col("lookback_minutes").cast("int").alias("lookback_minutes"), F.col("src_id").cast("double"), F.col("dst_id").cast("double"), "weight")
    return typed.groupBy(*KEY).applyInPandasWithState(advance, T.StructType.fromDDL(OUT), T.StructType.fromDDL(STATE), "append", GroupStateTimeout.NoTimeout)


def daily_bars_stream(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Tumbling one-day bars of a stream of (symbol, timestamp, value), with a watermark for late rows."""
    w = F.window("timestamp", "1 day")
    return events.withWatermark("timestamp", late).groupBy("symbol", w.alias("w")).agg(F.sum("value").alias("close"), F.count(F.lit(1)).alias("n_events")).select("symbol", F.col("w.start").alias("timestamp"), F.col("w.end").alias("available_time"), "close", "n_events")
