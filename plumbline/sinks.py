"""The canonical store: schema-checked day writes, catalog, manifests, shards, selective replacement, resume."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .config import LAYERS, BuildConfig
from .operators.graph import GROUP
from .operators.semantics import relabelled
from .schemas import TABLES, conform


DAY_TABLES = ("edges", "node_features", "snapshots", "labels")
#: What layer 0 is after some layers were rebuilt alone.
STALE = "stale_disabled_until_full_rebuild"


def _fs(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A JSON object in any file system, or None."""
    place, fs = _fs(spark, path)
    if not fs.exists(place):
        return None
    return json.loads("\n".join(r.value for r in spark.read.option("wholetext", "true").text(path).collect()))


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write beside path, then rename over it, in any file system."""
    place, fs = _fs(spark, path)
    beside, _ = _fs(spark, f"{path}.tmp-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, sort_keys=True, default=str).encode()))
    finally:
        out.close()
    fs.delete(place, False)
    fs.rename(beside, place)


class Store:
    """Tables under one root, partitioned by date. A day's write replaces that day alone, when it has been written whole."""

    def __init__(self, spark: SparkSession, root: str, level: int = 6):
        self.spark, self.root, self.level = spark, root.rstrip("/"), level

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write_day(self, table: str, rows: DataFrame, date: str) -> int:
        """Write a day's rows under the declared schema; their number, which goes to the day's row counts."""
        if table in TABLES:
            rows = conform(rows, TABLES[table])
        elif table == "labels":
            rows = rows.select(*(F.col(c).cast("float").alias(c) if c.startswith("label_") and t in ("double", "float", "int", "bigint") else F.col(c) for c, t in rows.dtypes))
        seen = Observation(f"{table}-{uuid.uuid4().hex}")
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
        rows.withColumn("date", F.lit(date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(self.level)).partitionBy("date").parquet(self.path(table))
        place = f"{self.root}/row_counts/date={date}.json"
        counts = {t: 0 for t in DAY_TABLES} | (read_json(self.spark, place) or {}) | {table: seen.get["n"]}
        write_json(self.spark, place, counts)
        return counts[table]

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def day(self, table: str, date: str) -> DataFrame:
        return self.read(table).where(F.col("date").cast("string") == date).drop("date")

    def write_dimensions(self, symbols: DataFrame) -> None:
        """The layer registry, and symbols with ids that never change: known symbols keep theirs, new ones follow in order.

        A dimension has one row a symbol of the universe; it stays a table here, new ids are ranks above the largest known.
        """
        new = symbols.select(F.col("symbol").cast("string").alias("symbol")).distinct()
        rows, last = None, -1
        if self.exists("symbols"):
            rows = self.read("symbols").select("symbol_id", "symbol")
            new = new.join(rows.select("symbol"), "symbol", "left_anti")
            last = rows.agg(F.max("symbol_id")).first()[0]
        ranked = new.select((F.row_number().over(Window.orderBy("symbol")) + F.lit(-1 if last is None else last)).cast("int").alias("symbol_id"), "symbol")
        swapped(self.spark, self.path("symbols"), ranked if rows is None else rows.unionByName(ranked))
        layers = [(0, "multiplex", "multiplex", False, 0, "", "30")]
        layers += [(x.layer_id, x.name, x.family, x.directed, x.lag_bars, ",".join(x.columns), ",".join(map(str, x.lookbacks))) for x in LAYERS]
        self.spark.createDataFrame(layers, "layer_id int, name string, family string, directed boolean, lag_bars int, columns string, lookbacks_minutes string").coalesce(1).write.mode("overwrite").parquet(self.path("layers"))

    def exists(self, table: str) -> bool:
        """Whether the table has anything but marks of finished writes."""
        place, fs = _fs(self.spark, self.path(table))
        return fs.exists(place) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(place))

    def catalog(self) -> list[str]:
        """Temporary views of the tables that exist, and of metadata (key, value); the engine's SQL surface."""
        names = [t for t in ("symbols", "layers", *DAY_TABLES) if self.exists(t)]
        for t in names:
            self.read(t).createOrReplaceTempView(t)
        self.set_metadata("schema_version", "canonical-v1")
        self.spark.createDataFrame(sorted(self.metadata().items()), "key string, value string").createOrReplaceTempView("metadata")
        return [*names, "metadata"]

    def metadata(self) -> dict[str, str]:
        return read_json(self.spark, f"{self.root}/metadata.json") or {}

    def set_metadata(self, key: str, value: str) -> None:
        """Insert or replace one key."""
        write_json(self.spark, f"{self.root}/metadata.json", self.metadata() | {key: value})

    def count_date_rows(self, date: str) -> dict[str, int]:
        return {t: self.day(t, date).count() if self.exists(t) else 0 for t in DAY_TABLES}

    def write_manifest(self, date: str, config: BuildConfig, fingerprint: dict, universe: int, columns: list[str], **more) -> dict:
        """Merge a built date into manifest.json: settings and their hash, the source's fingerprint, universe, columns, the date's row counts; the manifest."""
        place = f"{self.root}/manifest.json"
        value = read_json(self.spark, place) or {"dates": {}}
        value |= {"schema_version": "canonical-v1", "source": fingerprint, "config": asdict(config), "config_hash": config.digest(), "universe_count": universe, "node_feature_columns": columns, **more}
        value.setdefault("dates", {})[date] = self.count_date_rows(date)
        write_json(self.spark, place, value)
        return value

    def pending(self, wanted: DataFrame, table: str, keys: list[str]) -> DataFrame:
        """The wanted partitions that the table does not have: what a resumed run still has to do."""
        return wanted if not self.exists(table) else wanted.join(self.read(table).select(*keys).distinct(), keys, "left_anti")

    def patch_day(self, date: str, patches: dict[str, DataFrame], layer_ids: list[int], config: BuildConfig, fingerprint: dict) -> dict:
        """Replace layers of a day's edges, node features and snapshots; the statistics of each table.

        Every layer must be in every patch, keys must stay unique, and labels must not change: all is checked before
        anything is swapped. The manifest records the patch and marks layer 0 stale, since it saw the old layers.
        """
        keys = {"edges": [*GROUP, "src_id", "dst_id"], "node_features": [*GROUP, "symbol_id"], "snapshots": GROUP}
        before, stats, merged = self.labels_digest(date), {}, {}
        for table, patch in patches.items():
            patch = conform(patch, TABLES[table])
            missing = set(layer_ids) - {r[0] for r in patch.select("layer_id").distinct().collect()}
            if missing:
                raise ValueError(f"the patch of {table} lacks layers {sorted(missing)}")
            merged[table], counts = replaced_layers(self.day(table, date), patch, layer_ids, keys[table])
            stats[table] = counts.first().asDict()
            if stats[table].pop("duplicates"):
                raise ValueError(f"repeated keys in {table} after the patch")
        for table, rows in merged.items():
            swapped(self.spark, f"{self.path(table)}/date={date}", rows)
        if self.labels_digest(date) != before:
            raise ValueError("labels changed during the patch")
        place = f"{self.root}/manifest.json"
        value = read_json(self.spark, place) or {"dates": {}}
        history = [x for x in value.get("patch_history", []) if x["date"] != date]
        history.append({"date": date, "layer_ids": layer_ids, "config_hash": config.digest(), "source": fingerprint, "merge_stats": stats, "labels_sha256": before})
        value |= {"patch_history": sorted(history, key=lambda x: x["date"]), "multiplex_status": {"layer_id": 0, "status": STALE}, "config": asdict(config), "config_hash": config.digest()}
        value.setdefault("dates", {})[date] = self.count_date_rows(date)
        write_json(self.spark, place, value)
        return stats

    def labels_digest(self, date: str) -> str | None:
        """A digest of a day's label rows, whatever their order: the sum of their hashes and their number."""
        if not self.exists("labels"):
            return None
        rows = self.day("labels", date)
        total, n = rows.agg(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.count(F.lit(1))).first()
        return hashlib.sha256(f"{total}|{n}".encode()).hexdigest()


class ThemeStore(Store):
    """A store of theme tables by day, and read models of all days."""

    TABLES = ("temporal_edges", "layer_communities", "subcommunities", "themes", "lifecycle", "semantics")
    MODELS = {"themes": "theme_events", "lifecycle": "theme_lifecycle", "semantics": "theme_semantics"}

    def write_themes(self, date: str, **tables: DataFrame) -> dict[str, int]:
        """Write a day's tables, whole days at a time; a table without rows leaves no files."""
        unknown = set(tables) - set(self.TABLES)
        if unknown:
            raise ValueError(f"unknown theme tables: {sorted(unknown)}")
        return {name: self.write_day(name, rows, date) for name, rows in tables.items()}

    def build_read_models(self) -> list[str]:
        """Rebuild read_models/: all themes, lifecycle rows and semantics, and each path's latest theme."""
        made = []
        for table, model in self.MODELS.items():
            if self.exists(table):
                swapped(self.spark, f"{self.root}/read_models/{model}", self.read(table))
                made.append(model)
        if self.exists("themes"):
            w = Window.partitionBy("theme_path_id").orderBy(F.desc("snapshot_time"), F.desc("theme_instance_id"))
            latest = self.read("themes").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
            swapped(self.spark, f"{self.root}/read_models/active_theme_paths", latest)
            made.append("active_theme_paths")
        return made

    def relabel(self, metadata: DataFrame, dates: list[str] | None = None) -> dict[str, int]:
        """Give stored themes semantics from another metadata dimension: themes and semantics of each day are replaced; themes a day."""
        days = [str(r[0]) for r in self.read("themes").select(F.col("date").cast("string")).distinct().collect()]
        out = {}
        for date in sorted(days if dates is None else set(days) & set(dates)):
            themes, semantics = relabelled(self.day("themes", date), metadata)
            swapped(self.spark, f"{self.path('semantics')}/date={date}", semantics)
            swapped(self.spark, f"{self.path('themes')}/date={date}", themes)
            out[date] = self.day("themes", date).count()
        return out


class TableSink:
    """A table that batches are appended to, under the schema of the first batch; format parquet or csv."""

    def __init__(self, path: str, format: str = "parquet"):
        self.path, self.format, self.schema, self.rows = path, format, None, 0

    def write(self, batch: DataFrame) -> None:
        """Append a batch; missing columns are null, others than the first batch's raise ValueError. An empty first batch sets no schema."""
        seen = Observation(f"sink-{uuid.uuid4().hex}")
        if self.schema is not None:
            batch = conform(batch, self.schema)
        elif batch.isEmpty():
            return
        self.schema = self.schema or batch.schema
        writer = batch.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append")
        (writer.option("header", "true").csv(self.path) if self.format == "csv" else writer.option("compression", "zstd").parquet(self.path))
        self.rows += seen.get["n"]


def replaced_layers(base: DataFrame, patch: DataFrame, layer_ids: list[int], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(base without layer_ids, plus patch; one row of counts). The keys must be unique in the result, as duplicates counts them."""
    kept = base.where(~F.col("layer_id").isin(layer_ids))
    merged = kept.unionByName(patch, allowMissingColumns=True)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    twice = merged.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    stats = count(base, "baseline_rows").crossJoin(count(kept, "preserved_rows")).crossJoin(count(patch, "patch_rows")).crossJoin(count(merged, "merged_rows")).crossJoin(twice)
    return merged, stats


def swapped(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Write rows beside path and swap them in: readers see the old table or the new one. rows may be read from path."""
    place, fs = _fs(spark, path)
    new, old = (_fs(spark, f"{place.getParent().toString()}/_{side}-{uuid.uuid4().hex}")[0] for side in ("new", "old"))  # readers skip names that begin with _
    rows.write.option("compression", "zstd").parquet(new.toString())
    if fs.exists(place):
        fs.rename(place, old)
    fs.rename(new, place)
    fs.delete(old, True)


def replace_table(spark: SparkSession, path: str, rows: DataFrame, check: DataFrame) -> None:
    """Swap rows in for the table at path, unless check counts duplicates."""
    if check.first()["duplicates"]:
        raise ValueError("duplicate keys")
    swapped(spark, path, rows)


def flattened(spark: SparkSession, root: str, table: str, out: str) -> DataFrame:
    """Write the shards of a table (date=/layer_id=/scale=/ folders under root) as one table by date, with their keys as columns; rows a date."""
    rows = spark.read.option("basePath", root).parquet(f"{root}/date=*/layer_id=*/scale=*/{table}")
    rows.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date").parquet(out)
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("row_count"))


def write_shards(edges: DataFrame, root: str) -> DataFrame:
    """Edges dealt and written by date, layer and scale; the manifest of rows a shard."""
    keys = ["date", "layer_id", "scale"]
    edges.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(root)
    return edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
