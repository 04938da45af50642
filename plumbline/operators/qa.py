"""Measured quality gates over graphs, sources and stores; nothing here is assumed to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def edge_violations(edges: DataFrame, group: list[str], cap: int) -> DataFrame:
    """Per group: edges, duplicate pairs, self-loops, non-finite weights, and nodes above the degree cap."""
    finite = F.col("weight").isNotNull() & ~F.isnan(F.col("weight").cast("double")) & (F.abs(F.col("weight")) < float("inf"))
    pairs = edges.groupBy(*group, F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum((~finite).cast("long")).alias("odd"))
    sums = pairs.groupBy(*group).agg(F.sum("n").alias("edges"), F.sum(F.col("n") - 1).alias("duplicate_pairs"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("self_loops"), F.sum("odd").alias("non_finite"))
    degree = edges.select(*group, F.explode(F.array("src_id", "dst_id")).alias("node")).groupBy(*group, "node").count()
    over = degree.groupBy(*group).agg(F.sum((F.col("count") > cap).cast("long")).alias("cap_violations"))
    return sums.join(over, group)


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of only one side, with the side."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def universe_stability(rows: DataFrame, universe: DataFrame, date: str = "trade_date", examples: int = 20) -> DataFrame:
    """Per date of rows: expected symbols, how many of them are present, missing and unexpected ones, the first `examples` of both by name, and whether none is missing.

    Expected symbols are counted once and only present ones meet the dates; missing ones are found by the few dates that lack some.
    """
    present = rows.select(date, F.col("symbol").cast("string").alias("symbol")).distinct()
    expected = universe.select(F.col("symbol").cast("string").alias("symbol")).distinct().withColumn("_e", F.lit(True))
    on = present.join(expected, "symbol", "left")
    total = expected.agg(F.count(F.lit(1)).alias("expected_symbols"))
    per = on.groupBy(date).agg(F.count("_e").alias("present_expected_symbols"), F.count(F.when(F.col("_e").isNull(), 1)).alias("unexpected_count"))
    per = per.crossJoin(F.broadcast(total)).withColumn("missing_count", F.col("expected_symbols") - F.col("present_expected_symbols"))

    def listed(df: DataFrame, name: str) -> DataFrame:
        ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(date).orderBy("symbol"))).where(F.col("_r") <= examples)
        return ranked.groupBy(date).agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias(name))

    odd = listed(on.where("_e is null").select(date, "symbol"), "unexpected_examples")
    lacking = per.where("missing_count > 0").select(date)
    absent = lacking.crossJoin(expected.select("symbol")).join(present, [date, "symbol"], "left_anti")
    out = per.join(listed(absent, "missing_examples"), date, "left").join(odd, date, "left").fillna("", ["missing_examples", "unexpected_examples"])
    return out.withColumn("safe_for_full_rebuild", F.col("missing_count") == 0)


def benchmark_coverage(events: DataFrame, benchmarks: list, least: int, date: str = "trade_date", value: str = "close") -> DataFrame:
    """Per date and benchmark: available points, the share of the date's timestamps missing, and whether it falls back."""
    all_times = events.groupBy(date).agg(F.countDistinct("timestamp").alias("_t"))
    own = events.where(F.col("symbol").isin(benchmarks)).groupBy(date, "symbol").agg(F.count(value).alias("n"))
    names = events.sparkSession.createDataFrame([(b,) for b in benchmarks], events.select("symbol").schema)
    every = all_times.crossJoin(names).join(own, [date, "symbol"], "left").fillna({"n": 0})
    return every.select(date, "symbol", F.col("n").alias("available_points"), (1 - F.col("n") / F.col("_t")).alias("missing_ratio"), (F.col("n") < least).alias("fallback"))


def inventory(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))


def artifact_manifest(spark: SparkSession, path: str, time: str, pattern: str = "*.parquet") -> DataFrame:
    """A row for each Parquet file under path: file, size_bytes, sha256 of its bytes, row_count, schema (names joined by |), min_time and max_time.

    Files are hashed where they are read; one file is one value, so files of 2 GB or more cannot be hashed so.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    files = files.select(F.col("path").alias("_path"), name.alias("file"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(path)
    counts = rows.groupBy(F.col("_metadata.file_path").alias("_at")).agg(F.count(F.lit(1)).alias("row_count"), F.min(time).alias("min_time"), F.max(time).alias("max_time"))
    same = F.regexp_replace("_path", "^file:/+", "/") == F.regexp_replace("_at", "^file:/+", "/")
    out = files.join(counts, same, "left").withColumn("schema", F.lit("|".join(rows.columns)))
    return out.select("file", "size_bytes", "sha256", F.coalesce("row_count", F.lit(0)).alias("row_count"), "schema", "min_time", "max_time")


def report(tables: dict[str, DataFrame], title: str, most: int = 1000) -> str:
    """A Markdown report: a section and a table for each named result, or `No data.`; small results, `most` rows of each at most."""
    parts = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(most).collect()
        parts += [f"## {name}", ""]
        if rows:
            parts += ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in rows)]
        else:
            parts.append("No data.")
        parts.append("")
    return "\n".join(parts)
