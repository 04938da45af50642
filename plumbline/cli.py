"""Command line: build a date, rebuild some layers of it, find themes, relabel them, write the wide matrix, flatten shards, check and repair files.

    python -m plumbline.cli build-date --events PATH --store PATH --date 2024-01-02 [--config FILE] [--universe CSV]
    python -m plumbline.cli patch-layers ... --layers 1,14,15
    python -m plumbline.cli discover-themes --store PATH --themes PATH [--metadata CSV] [--dates D,D] [--run NAME]
    python -m plumbline.cli relabel-themes --themes PATH --metadata CSV [--dates D,D]
    python -m plumbline.cli features --events PATH --store PATH --start T --end T --out PATH
    python -m plumbline.cli flatten --shards PATH --table edges.parquet --out PATH
    python -m plumbline.cli check-files --path PATH
    python -m plumbline.cli repair-files --path PATH --mirror PATH
"""

from __future__ import annotations

import argparse
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import LAYERS, BuildConfig, load_config
from .operators import communities, features, pit
from .operators import semantics as semantic
from .plans.build import build_graphs, build_nodes, build_snapshots, node_signals
from .schemas import TABLES, conform
from .session import ship
from .sinks import Store, ThemeStore, _fs, flattened
from .sources.events import ParquetEvents, read_dimension, read_splits, utc_times
from .streaming.hysteresis import Hysteresis, replay


def day_inputs(source: ParquetEvents, date: str, config: BuildConfig, universe: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(the date's regular-session events of the universe, its decision grid); rows known before they happened raise ValueError."""
    events = pit.session_filter(source.load_date(date, source.numeric_features()), config.market_timezone, config.market_open, config.market_close)
    if universe is not None:
        events = events.join(universe.select(F.col("symbol").cast("string")).distinct(), "symbol", "left_semi")
    audit = pit.source_audit(events).first()
    if audit["early_rows"] or audit["duplicate_rows"]:
        raise ValueError(f"source violations: {audit.asDict()}")
    step = config.frequency.removesuffix("min") + " minutes"
    close = F.to_utc_timestamp(F.lit(f"{date} {config.market_close}:00").cast("timestamp"), config.market_timezone)
    return events, pit.decision_grid(events, step, close)


class DayBuild:
    """A date's products as tables: edges, node features, snapshots and labels."""

    def __init__(self, source: ParquetEvents, store: Store, date: str, config: BuildConfig, universe: DataFrame | None = None, layers: tuple = LAYERS):
        self.spark, self.source, self.store, self.date, self.config, self.layers = store.spark, source, store, date, config, layers
        ship(self.spark)
        self.events, self.grid = day_inputs(source, date, config, universe)
        present = self.events.select("symbol").distinct()
        store.write_dimensions(present)
        self.symbols = store.read("symbols").join(present, "symbol", "left_semi").persist()

    def write(self, names: dict[str, str]) -> dict[str, int]:
        """Write the tables under the given names; graphs are written first and read again for what follows from them."""
        graphs_path = f"{self.store.root}/_graphs-{uuid.uuid4().hex}"
        build_graphs(self.events, self.grid, self.symbols, self.config, self.layers).write.option("compression", "zstd").parquet(graphs_path)
        try:
            graphs = self.spark.read.parquet(graphs_path)
            signals = node_signals(self.events, self.grid, self.symbols, max(b for x in self.layers for b in x.lookbacks))
            nodes = build_nodes(graphs, self.symbols, signals)
            out = {"node_features": self.store.write_day(names["node_features"], nodes.withColumnRenamed("node_id", "symbol_id"), self.date)}
            stored = self.store.day(names["node_features"], self.date).withColumnRenamed("symbol_id", "node_id")
            out["edges"] = self.store.write_day(names["edges"], graphs.where("src_id is not null"), self.date)
            out["snapshots"] = self.store.write_day(names["snapshots"], build_snapshots(graphs, stored, self.symbols.count(), self.layers), self.date)
            return out
        finally:
            place, fs = _fs(self.spark, graphs_path)
            fs.delete(place, True)

    def write_labels(self) -> int:
        """Forward labels of every horizon on the as-of panel, split-adjusted where the configuration names splits."""
        panel = pit.pit_panel(self.events, self.grid, self.events.select("symbol").distinct(), "15 MINUTES", ["close"])
        labels = pit.forward_labels(panel, list(self.config.horizons_minutes), self.config.label_bar_minutes)
        if self.config.split_csv_path:
            splits = pit.normalized_splits(read_splits(self.spark, self.config.split_csv_path))
            for h in self.config.horizons_minutes:
                adjusted = pit.split_adjusted_labels(labels, splits, h)
                adjusted = adjusted.select("decision_time", "symbol", F.col("label_split_multiplier").alias(f"label_split_multiplier_{h}"), F.col("label_raw").alias(f"label_raw_{h}"), F.col("label_split_adj").alias("_adj"))
                labels = labels.join(adjusted, ["decision_time", "symbol"], "left").withColumn(f"label_{h}", F.col("_adj")).drop("_adj")
        on = labels.join(self.symbols.select("symbol_id", "symbol"), "symbol").drop("symbol")
        return self.store.write_day("labels", on, self.date)


def build_date(spark: SparkSession, source: ParquetEvents, store: Store, date: str, config: BuildConfig, universe: DataFrame | None = None) -> dict[str, int]:
    """Write a date's edges, node features, snapshots and labels, the views and the manifest; rows a table."""
    day = DayBuild(source, store, date, config, universe)
    counts = day.write({t: t for t in ("edges", "node_features", "snapshots")})
    if config.store_labels and "close" in day.events.columns:
        counts["labels"] = day.write_labels()
    store.catalog()
    store.write_manifest(date, config, source.fingerprint(), day.symbols.count(), source.numeric_features())
    return counts


def patch_date(spark: SparkSession, source: ParquetEvents, store: Store, date: str, config: BuildConfig, layer_ids: list[int], universe: DataFrame | None = None) -> dict:
    """Rebuild some layers of a written date and swap them in; the statistics a table. Layer 0 is left and marked stale."""
    day = DayBuild(source, store, date, config, universe, tuple(x for x in LAYERS if x.layer_id in layer_ids))
    staged = {t: f"_staged_{t}" for t in ("edges", "node_features", "snapshots")}
    day.write(staged)
    try:
        patches = {t: conform(store.day(name, date).where(F.col("layer_id") != 0), TABLES[t]) for t, name in staged.items()}
        return store.patch_day(date, patches, layer_ids, config, source.fingerprint())
    finally:
        for name in staged.values():
            place, fs = _fs(spark, store.path(name))
            fs.delete(place, True)


@dataclass(frozen=True)
class ThemeConfig:
    """Theme discovery settings; fixed defaults."""

    run_id: str = "theme_run"
    frame_minutes: int = 15
    resolution: float = 1.0
    child_resolution: float = 1.4
    min_members: int = 3
    min_parent: int = 30
    min_consensus_score: float = 0.35
    min_families: int = 2
    min_overlap: float = 0.5
    market_share: float = 0.15
    hysteresis: Hysteresis = Hysteresis()
    seed: int = 20260704


def discover_themes(spark: SparkSession, store: Store, themes: ThemeStore, config: ThemeConfig = ThemeConfig(), metadata: DataFrame | None = None, dates: list[str] | None = None) -> list[str]:
    """Edges of the store to theme tables by day and read models; the days written.

    Edges are replayed with hysteresis over all frames, communities and their parts found a graph, consensus themes a
    frame, lifecycles over all frames, then semantics and quality. Each step is written once, by day, and read again.
    """
    ship(spark)
    edges = store.read("edges").where("layer_id <> 0")
    if dates is not None:
        edges = edges.where(F.col("date").cast("string").isin(dates))
    layers = store.read("layers")
    families = {r.name: r.family for r in layers.collect()}
    universe = store.read("symbols").count()
    day = F.date_format("snapshot_time", "yyyy-MM-dd").alias("date")

    def kept(df: DataFrame, name: str) -> DataFrame:
        dated = df.withColumn("date", day)
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date").parquet(themes.path(name))
        written = spark.read.schema(dated.schema).parquet(themes.path(name))
        return (written if dates is None else written.where(F.col("date").isin(dates))).drop("date")

    temporal = kept(replay(edges.select("decision_time", "layer_id", "lookback_minutes", "src_id", "dst_id", "weight"), config.hysteresis).withColumnRenamed("decision_time", "snapshot_time"), "temporal_edges")
    named = temporal.join(layers.select(F.col("layer_id").cast("int"), "name"), "layer_id").withColumn("layer_name", F.concat(F.col("name"), F.lit("@"), F.col("lookback_minutes").cast("string"), F.lit("m")))
    found = communities.detect(named, ["snapshot_time", "layer_id", "layer_name"], config.resolution, config.seed, config.min_members, universe, config.market_share, config.child_resolution, config.min_parent)
    units = kept(found, "layer_communities")
    kept(units.where("parent_id is not null"), "subcommunities")
    built = communities.consensus_themes(units, families, config.min_consensus_score, config.min_families, config.min_members, config.seed, universe, config.market_share, config.run_id)
    staged = kept(built, "_candidates")
    life = kept(communities.lifecycle(staged.select("snapshot_time", "theme_instance_id", "members"), config.frame_minutes, config.min_overlap), "lifecycle")
    empty = spark.createDataFrame([], "symbol_id int, symbol string, company string, sector string, industry string, market_cap double")
    semantics = kept(semantic.labels(staged, metadata if metadata is not None else empty).join(staged.select("theme_instance_id", "snapshot_time"), "theme_instance_id"), "semantics")
    alive = life.where("status = 'active'").select("theme_instance_id", F.col("theme_path_id").alias("_path"), F.col("overlap").alias("stability_score"))
    scored = staged.join(alive, "theme_instance_id", "left").fillna({"stability_score": 0.0}).join(semantics.select("theme_instance_id", F.col("semantic_coherence_score").alias("semantic_score")), "theme_instance_id", "left").fillna({"semantic_score": 0.0})
    nodes = store.read("node_features").where("layer_id = 0").select(F.col("decision_time").alias("snapshot_time"), F.col("symbol_id").alias("member_id"), "neighbor_signed_flow")
    flow = scored.select("snapshot_time", "theme_instance_id", F.explode("members").alias("member_id")).join(nodes, ["snapshot_time", "member_id"]).groupBy("theme_instance_id").agg(F.least(F.lit(1.0), F.avg(F.abs("neighbor_signed_flow"))).alias("flow_support_score"))
    full = scored.join(flow, "theme_instance_id", "left").fillna({"flow_support_score": 0.0})
    quality = 0.35 * F.col("structure_score") + 0.25 * F.col("consensus_score") + 0.2 * F.col("stability_score") + 0.1 * F.col("semantic_score") + 0.1 * F.col("flow_support_score")
    parts = {"structure": "structure_score", "consensus": "consensus_score", "stability": "stability_score", "semantic": "semantic_score", "flow": "flow_support_score"}
    breakdown = F.to_json(F.create_map(*(x for k in sorted(parts) for x in (F.lit(k), F.col(parts[k]).cast("double")))))
    full = full.withColumns({"theme_quality_score": quality, "quality_breakdown": breakdown, "theme_path_id": F.coalesce("_path", "theme_path_id")}).withColumnRenamed("semantic_score", "semantic_coherence_score").drop("_path")
    kept(full, "themes")
    place, fs = _fs(spark, themes.path("_candidates"))
    fs.delete(place, True)
    themes.build_read_models()
    return sorted(str(r[0]) for r in themes.read("themes").select(F.col("date").cast("string")).distinct().collect()) if themes.exists("themes") else []


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of the Parquet files under path that cannot be read; a row a bad file.

    Files are listed, dealt to tasks and opened there, each read whole, a row group at a time.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pyarrow.parquet as pq

        for p in batches:
            bad = []
            for name, content in zip(p["path"], p["content"]):
                try:
                    file = pq.ParquetFile(io.BytesIO(content))
                    for n in range(file.num_row_groups):
                        file.read_row_group(n)
                except Exception as e:  # noqa: BLE001  any reader's error marks the file
                    bad.append((name, str(e)[:200]))
            yield pd.DataFrame(bad, columns=["path", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", "content").mapInPandas(check, "path string, error string")


def repair(spark: SparkSession, path: str, mirror: str) -> list[tuple[str, bool]]:
    """Replace unreadable files under path by those at the same place under mirror, after moving them aside; (file, whether it was found there)."""
    root, _ = _fs(spark, path)
    base = root.toUri().getPath().rstrip("/")
    out = []
    util = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for row in unreadable(spark, path).collect():
        bad, fs = _fs(spark, row.path)
        below = bad.toUri().getPath()[len(base) + 1 :]
        good, other = _fs(spark, f"{mirror.rstrip('/')}/{below}")
        found = other.exists(good)
        if found:
            aside = _fs(spark, f"{bad.getParent().toString()}/_{bad.getName()}.bad-{uuid.uuid4().hex}")[0]
            fs.rename(bad, aside)
            util.copy(other, good, fs, bad, False, conf)
            fs.delete(aside, False)
        out.append((below, found))
    return sorted(out)


#: Commands and their required options.
COMMANDS = {
    "build-date": ("events", "store", "date"), "patch-layers": ("events", "store", "date", "layers"), "features": ("events", "store", "start", "end", "out"), "discover-themes": ("store", "themes"), "relabel-themes": ("themes", "metadata"),
    "flatten": ("shards", "table", "out"), "check-files": ("path",), "repair-files": ("path", "mirror"),
}
OPTIONAL = {"features": ("config",), "build-date": ("config", "universe"), "patch-layers": ("config", "universe"), "discover-themes": ("metadata", "dates", "run"), "relabel-themes": ("dates",)}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="plumbline")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, options in COMMANDS.items():
        sub = commands.add_parser(name)
        for o in options:
            sub.add_argument(f"--{o}", required=True)
        for o in OPTIONAL.get(name, ()):
            sub.add_argument(f"--{o}")
    a = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "check-files":
        print("\n".join(f"{r.path}: {r.error}" for r in unreadable(spark, a.path).collect()) or "all files can be read")
    elif a.command == "repair-files":
        print("\n".join(f"{name}: {'replaced' if found else 'not in the mirror'}" for name, found in repair(spark, a.path, a.mirror)) or "all files can be read")
    elif a.command == "flatten":
        flattened(spark, a.shards, a.table, a.out).show()
    elif a.command in ("discover-themes", "relabel-themes"):
        dates = a.dates.split(",") if a.dates else None
        metadata = read_dimension(spark, a.metadata) if a.metadata else None
        if a.command == "relabel-themes":
            print(json.dumps(ThemeStore(spark, a.themes).relabel(metadata, dates)))
        else:
            config = ThemeConfig(run_id=a.run) if a.run else ThemeConfig()
            print("\n".join(discover_themes(spark, Store(spark, a.store), ThemeStore(spark, a.themes), config, metadata, dates)))
    elif a.command == "features":
        from .api import MatrixLoader  # which builds on this module

        config = load_config(a.config) if a.config else BuildConfig()
        MatrixLoader(utc_times(ParquetEvents(spark, a.events).table), Store(spark, a.store), config).materialize(a.out, a.start, a.end)
    else:
        source, store = ParquetEvents(spark, a.events), Store(spark, a.store)
        config = load_config(a.config) if a.config else BuildConfig()
        universe = spark.read.option("header", "true").csv(a.universe) if a.universe else None
        if a.command == "build-date":
            print(json.dumps(build_date(spark, source, store, a.date, config, universe)))
        else:
            print(json.dumps(patch_date(spark, source, store, a.date, config, [int(x) for x in a.layers.split(",")], universe)))


if __name__ == "__main__":
    main()
