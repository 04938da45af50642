"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from importlib.util import find_spec

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from plumbline import cli  # noqa: E402
from plumbline.config import LAYERS, BuildConfig  # noqa: E402
from plumbline.plans import catalog  # noqa: E402
from plumbline.session import local_session  # noqa: E402
from plumbline.sinks import Store  # noqa: E402
from plumbline.sources.events import ParquetEvents  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINES = (
    "pit_panel", "forward_labels", "split_adjusted_labels", "visible_windows", "trajectory_standardized", "corr_topk", "reciprocal_edges", "lsh_edges", "node_metrics", "multiplex", "snapshot_diagnostics", "temporal_diagnostics", "resonance",
    "modularity", "relation_edges", "theme_continuation", "theme_forest", "theme_returns", "spillover", "core_peripheral", "rank_ic", "consensus_pairs", "consensus_themes", "theme_lifecycle", "tracked_paths", "hysteresis_replay", "patch_merge", "wide_matrix", "graph_build", "graph_build_nodes", "graph_build_snapshots", "communities_detected", "candidate_scores", "structural_forest",
)
#: A day's build: symbols of the full universe, minutes of events, and the frequency of decisions.
SYMBOLS, MINUTES, FREQUENCY = 5557, 60, "15min"


def day_events(spark: SparkSession, path: str) -> None:
    """A session's first minutes of the full universe, with every column that the layers read; values hashed from symbol, minute and column."""
    columns = sorted({c for layer in LAYERS for c in layer.columns} | {"close"})
    rows = spark.range(SYMBOLS).select(F.format_string("S%05d", "id").alias("symbol"), (F.col("id") % 400).alias("_group"), F.explode(F.sequence(F.lit(0), F.lit(MINUTES - 1))).alias("_m"))
    at = F.lit("2024-01-02 14:30:00").cast("timestamp") + F.make_dt_interval(mins=F.col("_m"))
    noise = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(20011)) / 20011.0 - 0.5
    values = [(noise("symbol", "_m", F.lit(c)) + 2 * noise("_group", "_m", F.lit(c)) + (100 if c == "close" else 0)).alias(c) for c in columns]
    rows.select("symbol", at.alias("timestamp"), (at + F.expr("INTERVAL 1 MINUTE")).alias("available_time"), F.lit("2024-01-02").alias("trade_date"), *values).repartition(16, "symbol").write.parquet(path)


def day_build(spark: SparkSession) -> dict:
    """Build and store a part of a day as the command line does: windows, vectors, graphs of all 35 scales, node features with signals, snapshots, labels, manifest."""
    folder = tempfile.mkdtemp(prefix="plumbline-bench-")
    try:
        day_events(spark, f"{folder}/events")
        source, store = ParquetEvents(spark, f"{folder}/events"), Store(spark, f"{folder}/store")
        began = time.perf_counter()
        counts = cli.build_date(spark, source, store, "2024-01-02", BuildConfig(frequency=FREQUENCY))
        took = time.perf_counter() - began
        return {"seconds": round(took, 3), "edges": counts["edges"], "nodes": counts["node_features"], "snapshots": counts["snapshots"], "edges_per_sec": round(counts["edges"] / took)}
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def timed(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    spark = local_session(CPUS, CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["corr_topk"](spark, SF).write.format("noop").mode("overwrite").save()  # Python workers and code generation start here
    times = {name: timed(catalog.QUERIES[name](spark, SF)) for name in HEADLINES}
    day = day_build(spark)
    times["day_build"] = day["seconds"]
    if find_spec("plumbline.llm"):
        from plumbline.llm.queries import queries

        for name, query in queries().items():
            began = time.perf_counter()
            query(spark, SF).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF).removeprefix("sf"), "day_build": day}))


if __name__ == "__main__":
    main()
