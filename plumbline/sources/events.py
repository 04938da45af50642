"""Sources of bitemporal event tables, monthly packs, splits and edges."""

from __future__ import annotations

import hashlib
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ("symbol", "timestamp", "available_time")
IDENTITY = {*REQUIRED, "trade_date", "session_date", "factor_semantics_version", "trade_semantics_version"}


class EventSource(Protocol):
    """What the builders read: dates, a date's rows, and the numeric features."""

    def available_dates(self) -> DataFrame: ...

    def load_date(self, trade_date: str, columns: list[str] | None = None) -> DataFrame: ...

    def numeric_features(self) -> list[str]: ...


def numeric_features(df: DataFrame) -> list[str]:
    """Numeric columns that are no identity and no label."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in IDENTITY and not f.name.startswith("label_")]


def utc_times(df: DataFrame) -> DataFrame:
    """Times as timestamps: nanosecond columns that a reader gives as long are cut to microseconds."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.timestamp_micros((F.col(c) / 1000).cast("long")) if kinds[c] == "bigint" else F.col(c).cast("timestamp") for c in ("timestamp", "available_time") if c in kinds})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null in floating columns, so that aggregates skip it."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(t)) for c, t in kinds.items() if isinstance(t, (T.FloatType, T.DoubleType))})


class ParquetEvents:
    """A Parquet file, folder (with its subfolders) or glob. Filters and columns reach the scan."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.table = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "false").parquet(path)
        missing = set(REQUIRED) - set(self.table.columns)
        if missing:
            raise ValueError(f"missing columns: {sorted(missing)}")

    def available_dates(self) -> DataFrame:
        return self.table.select("trade_date").distinct().orderBy("trade_date")

    def load_date(self, trade_date: str, columns: list[str] | None = None) -> DataFrame:
        rows = self.table.where(F.col("trade_date") == trade_date)
        if columns is not None:
            rows = rows.select(*dict.fromkeys([*REQUIRED, "trade_date", *columns]))
        return utc_times(rows.withColumn("symbol", F.col("symbol").cast("string")))

    def numeric_features(self) -> list[str]:
        return numeric_features(self.table)

    def fingerprint(self) -> dict:
        """Files' number, bytes and rows, SHA-256 of the schema and of the files' names, sizes, times and rows, and the semantics versions present."""
        versions = [c for c in ("factor_semantics_version", "trade_semantics_version") if c in self.table.columns]
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.path).select("path", F.col("length").alias("bytes"), F.unix_micros("modificationTime").alias("at"))
        counts = self.table.groupBy(F.col("_metadata.file_path").alias("_at")).agg(F.count(F.lit(1)).alias("rows"), *(F.collect_set(F.col(c).cast("string")).alias(c) for c in versions))
        bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
        files = listed.join(counts, bare("path") == bare("_at"), "left").fillna(0, ["rows"])
        line = F.concat_ws("|", "path", *(F.col(c).cast("string") for c in ("bytes", "at", "rows")))
        row = files.agg(
            F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.sha2(line, 256)))).cast("binary"), 256).alias("file_metadata_sha256"),
            *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(f"{c}s") for c in versions),
        ).first()
        return {"path": self.path, "schema_sha256": hashlib.sha256(self.table.schema.json().encode()).hexdigest(), **row.asDict()}


class MonthPack:
    """month=/<table>/date=/ folders; tables node_factors_5m, trade_flow_1m and raw_1m. Months and dates prune partitions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def load(self, table: str, month: str, date: str | None = None, columns: list[str] | None = None) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.root}/month={month}/{table}").parquet(f"{self.root}/month={month}/{table}/date=*")
        rows = rows if date is None else rows.where(F.col("date") == date)
        return rows if columns is None else rows.select(*columns)

    def available_dates(self, month: str, table: str = "node_factors_5m") -> DataFrame:
        return self.load(table, month).select(F.col("date").cast("string").alias("date")).distinct().orderBy("date")

    def available_months(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.root)
        names = [s.getPath().getName() for s in place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)]
        return sorted(n.removeprefix("month=") for n in names if n.startswith("month="))


class MonthEvents:
    """One month of a pack as an EventSource."""

    def __init__(self, pack: MonthPack, month: str):
        self.pack, self.month = pack, month

    def available_dates(self) -> DataFrame:
        return self.pack.available_dates(self.month)

    def load_date(self, trade_date: str, columns: list[str] | None = None) -> DataFrame:
        return self.pack.load("node_factors_5m", self.month, trade_date, columns)

    def numeric_features(self) -> list[str]:
        return numeric_features(self.pack.load("node_factors_5m", self.month))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, effective_date, ratio) of a CSV with symbol, date, from and to; a byte-order mark is dropped, bad numbers are null."""
    rows = spark.read.option("header", "true").csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip().lower() for c in rows.columns))
    missing = {"symbol", "date", "from", "to"} - set(rows.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return rows.select("symbol", F.expr("try_to_date(date)").alias("effective_date"), F.try_divide(F.expr("try_cast(`to` AS double)"), F.expr("try_cast(`from` AS double)")).alias("ratio"))


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """A metadata CSV; *_name and *_code columns lose their endings."""
    rows = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    return rows.withColumnsRenamed({c: c.removesuffix("_name").removesuffix("_code") for c in rows.columns})


#: Names under which edge files give their columns, first match first.
EDGE_NAMES = {
    "src_id": ("src_id", "source_id", "src", "source"), "dst_id": ("dst_id", "target_id", "dst", "target"),
    "weight": ("weight", "edge_weight", "score"), "layer_id": ("layer_id", "layer", "layer_name"), "decision_time": ("decision_time", "snapshot_time", "ts"),
}


def normalized_edges(rows: DataFrame) -> DataFrame:
    """(decision_time, layer_id, scale, src_id, dst_id, weight, abs_weight) of edges under any of EDGE_NAMES, without self-loops.

    scale is the lookback in minutes with an m, else the column scale, else `default`; a time column that is absent is
    `unknown`. Weights that are null or no number are 0. Another column that is absent raises ValueError.
    """
    found = {name: next((c for c in options if c in rows.columns), None) for name, options in EDGE_NAMES.items()}
    absent = [n for n, c in found.items() if c is None and n != "decision_time"]
    if absent:
        raise ValueError(f"missing columns: {absent}, found {rows.columns}")
    if "lookback_minutes" in rows.columns:
        scale = F.concat(F.col("lookback_minutes").cast("string"), F.lit("m"))
    else:
        scale = F.col("scale").cast("string") if "scale" in rows.columns else F.lit("default")
    time = F.col(found["decision_time"]) if found["decision_time"] else F.lit("unknown")
    weight = F.coalesce(F.nanvl(F.col(found["weight"]).try_cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    out = rows.select(time.alias("decision_time"), F.col(found["layer_id"]).alias("layer_id"), scale.alias("scale"), *(F.col(found[c]).cast("long").alias(c) for c in ("src_id", "dst_id")), weight.alias("weight"))
    return out.withColumn("abs_weight", F.abs("weight")).where("src_id <> dst_id")


def partitions(spark: SparkSession, root: str, file: str | None = None, **wanted: list) -> DataFrame:
    """(path, bytes, one column a key) of files under root whose folders are named key=value, largest first.

    file: a file's name; wanted: the values of a key to keep, e.g. layer_id=["1", "14"]. Only listings are read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", file or "*.parquet").load(root).select("path", F.col("length").alias("bytes"))
    found = found.withColumn("_keys", F.expr("map_from_entries(transform(filter(split(path, '/'), x -> instr(x, '=') > 1), x -> struct(substring_index(x, '=', 1), substr(x, instr(x, '=') + 1))))"))
    for key, values in wanted.items():
        found = found.where(F.col("_keys")[key].isin([str(v) for v in values]))
    return found.select("path", "bytes", F.col("_keys").alias("keys")).orderBy(F.desc("bytes"), "path")


def read_shard(spark: SparkSession, path: str) -> DataFrame:
    """A shard's edges under one set of names, in order of time; scale `default` where absent."""
    return normalized_edges(spark.read.parquet(path)).orderBy("decision_time", "src_id", "dst_id")


def first_groups(edges: DataFrame, most: int, keys: list[str] = ["decision_time", "layer_id", "scale"]) -> DataFrame:
    """The edges of the first `most` groups in order of their keys: a cap that a caller asks for, on groups and not on rows."""
    return edges.join(edges.select(*keys).distinct().orderBy(*keys).limit(most), keys, "left_semi")


def canonical_edges(spark: SparkSession, root: str, dates: list[str] | None = None) -> DataFrame:
    """The store's edges, pruned to dates."""
    rows = spark.read.option("basePath", f"{root}/edges").parquet(f"{root}/edges")
    return rows if dates is None else rows.where(F.col("date").cast("string").isin(dates))
