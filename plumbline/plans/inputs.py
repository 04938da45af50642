"""How the driver's tables stand in for bitemporal events, labels, edges and themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars of users: symbol, timestamp (the day), available_time (the next), close, n_events, signed_flow, top_value."""
    signed = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(-F.col("value"))
    day = F.date_trunc("day", "ts")
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("symbol"), day.alias("timestamp")).agg(F.round(F.sum("value"), 6).alias("close"), F.count(F.lit(1)).alias("n_events"), F.round(F.sum(signed), 6).alias("signed_flow"), F.max("value").alias("top_value")).withColumn("available_time", F.col("timestamp") + F.expr("INTERVAL 1 DAY"))


BARS = """
bars AS (
  SELECT user_id AS symbol, date_trunc('day', ts)::TIMESTAMP AS "timestamp", date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS available_time, round(sum(value), 6) AS "close", count(*) AS n_events,
    round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE -value END), 6) AS signed_flow, max(value) AS top_value
  FROM events GROUP BY 1, 2
)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly graphs of three layers: suppliers and part classes that meet in line items, weighted by discount."""
    a, b = F.col("l_suppkey"), F.col("l_partkey") % 100
    rows = table(spark, sf, "lineitem").select(F.date_trunc("year", "l_shipdate").alias("decision_time"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("layer_id"), F.lit(30).alias("lookback_minutes"), F.least(a, b).alias("src_id"), F.greatest(a, b).alias("dst_id"), "l_discount").where("src_id <> dst_id")
    return rows.groupBy("decision_time", "layer_id", "lookback_minutes", "src_id", "dst_id").agg(F.round(F.avg("l_discount") * 10, 6).alias("weight"))


EDGES = """
edges AS (
  SELECT date_trunc('year', l_shipdate)::TIMESTAMP AS decision_time, (l_linenumber % 3 + 1)::INTEGER AS layer_id, 30 AS lookback_minutes,
    least(l_suppkey, l_partkey % 100) AS src_id, greatest(l_suppkey, l_partkey % 100) AS dst_id, round(avg(l_discount) * 10, 6) AS weight
  FROM lineitem WHERE l_suppkey <> l_partkey % 100 GROUP BY 1, 2, 3, 4, 5
)"""
FAMILIES = [(1, "price"), (2, "activity"), (3, "activity")]


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the daily bars for one and two days: label_h = close in h + 1 days over close in one day, less 1."""
    b = bars(spark, sf)
    price = lambda n, name: b.select("symbol", (F.col("timestamp") - F.expr(f"INTERVAL {n} DAY")).alias("decision_time"), F.col("close").alias(name))
    key = ["symbol", "decision_time"]
    out = b.select("symbol", F.col("timestamp").alias("decision_time")).join(price(1, "entry"), key, "left").join(price(2, "one"), key, "left").join(price(3, "two"), key, "left")
    return out.select(*key, *(F.round(F.try_divide(c, "entry") - 1, 6).alias(f"label_{h}") for h, c in ((1, "one"), (2, "two"))))


LABELS = BARS + """,
labels AS (
  SELECT b.symbol, b."timestamp" AS decision_time, round(x."close" / nullif(e."close", 0) - 1, 6) AS label_1, round(y."close" / nullif(e."close", 0) - 1, 6) AS label_2 FROM bars b
  LEFT JOIN bars e ON e.symbol = b.symbol AND e."timestamp" = b."timestamp" + INTERVAL 1 DAY
  LEFT JOIN bars x ON x.symbol = b.symbol AND x."timestamp" = b."timestamp" + INTERVAL 2 DAY
  LEFT JOIN bars y ON y.symbol = b.symbol AND y."timestamp" = b."timestamp" + INTERVAL 3 DAY
)"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Ten themes a day: users by id modulo 10, with the events of the day as core score over the theme's most."""
    b = bars(spark, sf).select(F.col("timestamp").alias("decision_time"), F.lit(2).alias("layer_id"), F.lit("30").alias("scale"), F.lit("B35").alias("level"), F.concat(F.lit("t"), (F.col("symbol") % 10).cast("string")).alias("theme_id"), F.col("symbol").alias("member_id"), "n_events")
    top = b.groupBy("decision_time", "theme_id").agg(F.max("n_events").alias("top"))
    return b.join(top, ["decision_time", "theme_id"]).withColumn("core_score", F.round(F.col("n_events") / F.col("top"), 6)).drop("n_events", "top")


MEMBERS = """
members AS (
  SELECT "timestamp" AS decision_time, 2 AS layer_id, '30' AS scale, 'B35' AS level, 't' || (symbol % 10) AS theme_id, symbol AS member_id,
    round(n_events / max(n_events) OVER (PARTITION BY "timestamp", symbol % 10), 6) AS core_score FROM bars
)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as nodes of one graph a label."""
    return table(spark, sf, "embeddings").select(F.col("label").alias("layer_id"), F.col("vec_id").alias("node_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select(F.col("c_custkey").alias("symbol_id"), F.col("c_custkey").alias("symbol"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("sector"), F.col("n_name").alias("industry"), (F.col("c_acctbal") * 1e7).alias("market_cap"))


METADATA = """
metadata AS (
  SELECT c_custkey AS symbol_id, c_custkey AS symbol, c_name AS company, c_mktsegment AS sector, n_name AS industry, c_acctbal * 1e7 AS market_cap FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
)"""
