"""What users call: build dates into a store, load the wide matrix, and hand out graphs by time."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cli
from .config import BuildConfig
from .operators import features, pit
from .sinks import Store
from .sources.events import EventSource, numeric_features

METRICS = ["degree", "strength", "core_z", "neighbor_reversal", "neighbor_signed_flow", "layer_participation"]


class GraphStore(Protocol):
    """What the builders write to."""

    def write_dimensions(self, symbols: DataFrame) -> None: ...

    def write_day(self, table: str, rows: DataFrame, date: str) -> int: ...

    def catalog(self) -> list[str]: ...


class GraphPipeline:
    """Builds dates of a source into a store under one configuration."""

    def __init__(self, source: EventSource, store: Store, config: BuildConfig | None = None):
        self.source, self.store, self.config = source, store, config or BuildConfig()

    def build_date(self, date: str, universe: DataFrame | None = None) -> dict[str, int]:
        return cli.build_date(self.store.spark, self.source, self.store, date, self.config, universe)

    def patch_date(self, date: str, layer_ids: list[int], universe: DataFrame | None = None) -> dict:
        return cli.patch_date(self.store.spark, self.source, self.store, date, self.config, layer_ids, universe)

    def build_pending(self, dates: list[str] | None = None) -> dict[str, dict[str, int]]:
        """Build those of the source's dates that the store's edges do not have."""
        wanted = [str(r[0]) for r in self.source.available_dates().collect()] if dates is None else dates
        table = self.store.spark.createDataFrame([(d,) for d in wanted], "date string").withColumn("date", F.to_date("date"))
        due = sorted(str(r[0]) for r in self.store.pending(table, "edges", ["date"]).collect())
        return {date: self.build_date(date) for date in due}


class MatrixLoader:
    """The wide (datetime, instrument) matrix of a store: as-of features of the sessions, labels, and graph features."""

    def __init__(self, source_table: DataFrame, store: Store, config: BuildConfig | None = None, include_graph: bool = True):
        self.table, self.store, self.config, self.include_graph = source_table, store, config or BuildConfig(), include_graph

    def grid(self, events: DataFrame) -> DataFrame:
        """(decision_time) of every session: from its first availability, rounded up, to its last, rounded down, no later than the close."""
        width = int(self.config.frequency.removesuffix("min")) * 60
        close = F.unix_seconds(F.to_utc_timestamp(F.concat(F.col("session_date").cast("string"), F.lit(f" {self.config.market_close}:00")).cast("timestamp"), self.config.market_timezone))
        span = events.groupBy("session_date").agg(F.ceil(F.unix_micros(F.min("available_time")) / (width * 10**6)).alias("a"), F.floor(F.unix_micros(F.max("available_time")) / (width * 10**6)).alias("b"))
        span = span.withColumn("b", F.least("b", F.floor(close / width))).where("a <= b")
        return span.select(F.explode(F.transform(F.sequence("a", "b"), lambda k: F.timestamp_seconds(k * width))).alias("decision_time")).distinct()

    def load(self, instruments: list[str] | None = None, start=None, end=None) -> DataFrame:
        """(datetime, instrument) with feature__, feature__graph__<layer>__<metric> and label__ columns; bounds inclusive, one plan for all dates."""
        events = pit.session_filter(self.table.withColumn("symbol", F.col("symbol").cast("string")), self.config.market_timezone, self.config.market_open, self.config.market_close)
        columns = numeric_features(self.table)
        panel = pit.pit_panel(events, self.grid(events), events.select("symbol").distinct(), "15 MINUTES", ["close", *(c for c in columns if c != "close")])
        symbols = self.store.read("symbols")
        labels = panel.select("decision_time", "symbol")
        if self.store.exists("labels"):
            labels = self.store.read("labels").drop("date").join(symbols, "symbol_id").drop("symbol_id")
        graph = None
        if self.include_graph and self.store.exists("node_features"):
            names = {r.layer_id: r.name for r in self.store.read("layers").collect()}
            nodes = self.store.read("node_features").join(symbols, "symbol_id")
            graph = features.graph_pivot(nodes, names, METRICS)
        return features.wide_matrix(panel.select("decision_time", "symbol", *columns), labels, graph, start, end, instruments)

    def materialize(self, path: str, start=None, end=None) -> None:
        """Write the matrix."""
        self.load(start=start, end=end).write.mode("overwrite").option("compression", "zstd").parquet(path)


class GraphBatches:
    """Stored graphs by decision time; date, time and layers prune what is read."""

    def __init__(self, store: Store):
        self.store = store

    def times(self, date: str) -> list:
        return [r[0] for r in self.store.day("snapshots", date).select("decision_time").distinct().orderBy("decision_time").collect()]

    def snapshot(self, date: str, time, layer_ids: list[int] | None = None) -> dict[str, DataFrame]:
        """The edges and node features of one time and of the given layers; node features keep layer 0."""
        return {
            "edges": features.snapshot(self.store.day("edges", date), time, layer_ids),
            "node_features": features.snapshot(self.store.day("node_features", date), time, layer_ids, keep_multiplex=True),
        }
