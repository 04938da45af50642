"""The registered queries: each operator on the driver's tables, beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BuildConfig, Layer
from ..functions.tokens import safe_token
from ..operators import alpha, communities, diagnostics, features, forest, graph, paths, pit, qa, semantics, trajectory
from ..session import ship
from ..sinks import replaced_layers
from ..sources.events import nan_to_null, normalized_edges, numeric_features
from ..streaming import hysteresis
from . import build
from . import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
G = diagnostics.GROUP
G_SQL = "decision_time, layer_id, lookback_minutes"


def query(sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a query under its function's name. needs: common table expressions that its SQL reads."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return f(spark, sf)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = ("WITH " + ",".join(n.strip() for n in needs) + "\n" if needs else "") + sql.strip()
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def day(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


DAY = "strftime({}, '%Y-%m-%d %H:%M:%S')"


# ---- sources and panels


@query("SELECT event_id, user_id, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d') AS session_date FROM events WHERE strftime(timezone('America/New_York', timezone('UTC', ts)), '%H:%M') >= '09:30' AND strftime(timezone('America/New_York', timezone('UTC', ts)), '%H:%M') < '16:00'")
def session_filter(spark, sf):
    out = pit.session_filter(I.table(spark, sf, "events"), "America/New_York", "09:30", "16:00", "ts")
    return out.select("event_id", "user_id", F.col("session_date").cast("string"))


@query('SELECT count(*) AS row_count, count(*) FILTER (WHERE available_time < "timestamp") AS early_rows, count(*) - count(DISTINCT (symbol, "timestamp")) AS duplicate_rows FROM bars', (I.BARS,))
def source_audit(spark, sf):
    return pit.source_audit(I.bars(spark, sf))


@query(f'SELECT DISTINCT {DAY.format("timestamp")} AS trade_date FROM bars', (I.BARS,))
def available_dates(spark, sf):
    return I.bars(spark, sf).select(day("timestamp").alias("trade_date")).distinct()


@query("SELECT symbol, \"close\", signed_flow FROM bars WHERE \"timestamp\" = TIMESTAMP '2024-01-10'", (I.BARS,))
def load_date(spark, sf):
    return I.bars(spark, sf).where(F.col("timestamp") == F.lit("2024-01-10").cast("timestamp")).select("symbol", "close", "signed_flow")


@query("SELECT unnest(['close', 'n_events', 'signed_flow', 'top_value']) AS feature")
def numeric_feature_names(spark, sf):
    return spark.createDataFrame([(c,) for c in numeric_features(I.bars(spark, sf))], "feature string")


@query(f"SELECT {DAY.format('t')} AS decision_time FROM (SELECT unnest(generate_series(min(available_time), max(available_time), INTERVAL 1 DAY)) AS t FROM bars)", (I.BARS,))
def decision_grid(spark, sf):
    return pit.decision_grid(I.bars(spark, sf), "1 day").select(day("decision_time").alias("decision_time"))


PANEL = """
grid AS (SELECT unnest(generate_series((SELECT min(available_time) FROM bars), (SELECT max(available_time) FROM bars), INTERVAL 6 HOUR)) AS t),
points AS (SELECT t, symbol FROM grid, (SELECT DISTINCT symbol FROM bars)),
panel AS (
  SELECT p.t AS decision_time, p.symbol, b.available_time, b."timestamp", b."close" FROM points p ASOF JOIN bars b ON p.symbol = b.symbol AND p.t >= b.available_time
  WHERE b.available_time >= p.t - INTERVAL 36 HOUR AND b."close" IS NOT NULL
)"""


def _panel(spark, sf):
    b = I.bars(spark, sf)
    return pit.pit_panel(b, pit.decision_grid(b, "6 hours"), b.select("symbol").distinct(), "36 HOURS", ["close"])


@query(f'SELECT {DAY.format("decision_time")} AS decision_time, symbol, {DAY.format("available_time")} AS available_time, "close" FROM panel', (I.BARS, PANEL))
def pit_panel(spark, sf):
    return _panel(spark, sf).select(day("decision_time").alias("decision_time"), "symbol", day("available_time").alias("available_time"), "close")


@query("SELECT count(*) AS row_count, count(*) FILTER (WHERE available_time > decision_time) AS look_ahead_rows, count(*) - count(DISTINCT (decision_time, symbol)) AS duplicate_rows FROM panel", (I.BARS, PANEL))
def panel_audit(spark, sf):
    return pit.panel_audit(_panel(spark, sf))


def _daily_labels(spark, sf):
    panel = I.bars(spark, sf).select("symbol", F.col("timestamp").alias("decision_time"), "close")
    return pit.forward_labels(panel, [1, 3], 1, "days")


FORWARD = """
fw AS (
  SELECT b.symbol, b."timestamp" AS decision_time, e."close" AS label_entry_price, x."close" AS exit_1, y."close" AS exit_3 FROM bars b
  LEFT JOIN bars e ON e.symbol = b.symbol AND e."timestamp" = b."timestamp" + INTERVAL 1 DAY
  LEFT JOIN bars x ON x.symbol = b.symbol AND x."timestamp" = b."timestamp" + INTERVAL 2 DAY
  LEFT JOIN bars y ON y.symbol = b.symbol AND y."timestamp" = b."timestamp" + INTERVAL 4 DAY
)"""


@query(f"SELECT {DAY.format('decision_time')} AS decision_time, symbol, label_entry_price, round(exit_1 / nullif(label_entry_price, 0) - 1, 6) AS label_1, round(exit_3 / nullif(label_entry_price, 0) - 1, 6) AS label_3 FROM fw", (I.BARS, FORWARD))
def forward_labels(spark, sf):
    out = _daily_labels(spark, sf).select(day("decision_time").alias("decision_time"), "symbol", "label_entry_price", "label_1", "label_3")
    return rounded(out, "label_1", "label_3")


def _splits(spark, sf):
    e = I.table(spark, sf, "events").where("event_type = 'signup'")
    ratio = F.when(F.col("event_id") % 3 == 0, 2.0).when(F.col("event_id") % 3 == 1, 0.5).otherwise(3.0)
    return e.select(F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("symbol"), F.to_date("ts").alias("effective_date"), ratio.alias("ratio"))


SPLITS = """
sp AS (SELECT symbol, effective_date, product(ratio) AS share_multiplier, count(*) AS component_count FROM (
  SELECT DISTINCT user_id::VARCHAR AS symbol, ts::DATE AS effective_date, CASE event_id % 3 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 3.0::DOUBLE END AS ratio FROM events WHERE event_type = 'signup') GROUP BY 1, 2)"""


@query("SELECT symbol, effective_date::VARCHAR AS effective_date, round(share_multiplier, 6) AS share_multiplier, component_count FROM sp", (SPLITS,))
def normalized_splits(spark, sf):
    out = pit.normalized_splits(_splits(spark, sf)).withColumn("effective_date", F.col("effective_date").cast("string"))
    return rounded(out, "share_multiplier")


@query(f"""SELECT {DAY.format('l.decision_time')} AS decision_time, l.symbol, round(coalesce(product(s.share_multiplier), 1), 6) AS label_split_multiplier,
  round(any_value(exit_3 / nullif(label_entry_price, 0)) - 1, 6) AS label_raw, round(any_value(exit_3) * coalesce(product(s.share_multiplier), 1) / nullif(any_value(label_entry_price), 0) - 1, 6) AS label_split_adj
  FROM fw l LEFT JOIN sp s ON s.symbol = l.symbol::VARCHAR AND s.effective_date > (l.decision_time + INTERVAL 1 DAY)::DATE AND s.effective_date <= (l.decision_time + INTERVAL 4 DAY)::DATE GROUP BY 1, 2""", (I.BARS, FORWARD, SPLITS))
def split_adjusted_labels(spark, sf):
    out = pit.split_adjusted_labels(_daily_labels(spark, sf), pit.normalized_splits(_splits(spark, sf)), 3)
    out = out.select(day("decision_time").alias("decision_time"), "symbol", "label_split_multiplier", "label_raw", "label_split_adj")
    return rounded(out, "label_split_multiplier", "label_raw", "label_split_adj")


@query('SELECT symbol, count(DISTINCT "timestamp") AS times, count(*) AS n FROM bars GROUP BY symbol HAVING count(DISTINCT "timestamp") >= 20 ORDER BY n DESC, symbol LIMIT 50', (I.BARS,))
def universe_selection(spark, sf):
    return pit.universe(I.bars(spark, sf), 20, 50)


@query(f"""SELECT {DAY.format('t')} AS decision_time, l.lookback, count(*) AS rows_seen, count(DISTINCT symbol) AS symbols FROM
  (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS t), (SELECT unnest([5, 15, 30]) AS lookback) l, bars
  WHERE available_time <= t AND "timestamp" <= t AND "timestamp" > t - lookback * INTERVAL 1 DAY GROUP BY 1, 2""", (I.BARS,))
def visible_windows(spark, sf):
    b = I.bars(spark, sf)
    out = pit.visible_windows(b, [5, 15, 30], 86400, pit.decision_grid(b, "1 day"))
    return out.groupBy(day("decision_time").alias("decision_time"), "lookback").agg(F.count(F.lit(1)).alias("rows_seen"), F.countDistinct("symbol").alias("symbols"))


@query(f"SELECT {DAY.format('t')} AS decision_time FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-31 00:00:00', INTERVAL 6 HOUR)) AS t) WHERE hour(t) % 12 = 0")
def due_decisions(spark, sf):
    times = pit.decision_grid(I.bars(spark, sf), "6 hours")
    return pit.due(times, F.lit("2024-01-02").cast("timestamp"), 720).select(day("decision_time").alias("decision_time"))


@query('SELECT symbol, "timestamp"::DATE::VARCHAR AS d FROM (SELECT *, dense_rank() OVER (ORDER BY "timestamp") - 1 AS r FROM bars) WHERE r % 5 = 0', (I.BARS,))
def every_fifth(spark, sf):
    return pit.every_kth(I.bars(spark, sf), 5, "timestamp").select("symbol", F.to_date("timestamp").cast("string").alias("d"))


@query(f"""SELECT {DAY.format('t')} AS decision_time, count(symbol) AS eligible, count(symbol) FILTER (WHERE available_time <= t) AS visible, count(symbol) FILTER (WHERE available_time > t) AS filtered, count(DISTINCT CASE WHEN available_time <= t THEN symbol END) AS symbols
  FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS t) LEFT JOIN bars ON "timestamp" <= t AND "timestamp" > t - INTERVAL 5 DAY GROUP BY 1""", (I.BARS,))
def pit_qa(spark, sf):
    b = I.bars(spark, sf)
    return pit.pit_qa(b, pit.decision_grid(b, "1 day"), 5, 86400).withColumn("decision_time", day("decision_time"))


@query("SELECT greatest(1, round(median(g))::BIGINT) AS frame_minutes FROM (SELECT date_diff('second', lag(t) OVER (ORDER BY t), t) / 60.0 AS g FROM (SELECT DISTINCT \"timestamp\" AS t FROM bars)) WHERE g > 0", (I.BARS,))
def cadence(spark, sf):
    return pit.cadence(I.bars(spark, sf), "timestamp")


# ---- trajectories

CELL = ["lookback"]
FILLED = """
obs AS (SELECT symbol, "timestamp", 'close' AS feature, "close" AS value FROM bars UNION ALL SELECT symbol, "timestamp", 'signed_flow', signed_flow FROM bars),
med AS (SELECT "timestamp", feature, median(value) AS middle FROM obs GROUP BY 1, 2),
filled AS (SELECT m."timestamp", m.feature, s.symbol, coalesce(o.value, m.middle, 0) AS value FROM med m CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN obs o ON o.symbol = s.symbol AND o."timestamp" = m."timestamp" AND o.feature = m.feature)"""


def _filled(spark, sf):
    b = I.bars(spark, sf).withColumn("lookback", F.lit(30))
    values = trajectory.last_values(b, ["close", "signed_flow"], CELL)
    return trajectory.median_filled(values, b.select("symbol").distinct(), CELL)


@query(f'SELECT {DAY.format("timestamp")} AS "timestamp", feature, symbol, round(value, 6) AS value FROM filled', (I.BARS, FILLED))
def trajectory_filled(spark, sf):
    return rounded(_filled(spark, sf).select(day("timestamp").alias("timestamp"), "feature", "symbol", "value"), "value")


@query(f"""SELECT {DAY.format('timestamp')} AS "timestamp", feature, symbol, round(CASE WHEN s > 1e-12 THEN (value - m) / s ELSE 0 END, 6) AS z FROM (
  SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM filled WINDOW w AS (PARTITION BY symbol, feature))""", (I.BARS, FILLED))
def trajectory_standardized(spark, sf):
    return rounded(trajectory.standardized(_filled(spark, sf), CELL).select(day("timestamp").alias("timestamp"), "feature", "symbol", "z"), "z")


@query(f'SELECT {DAY.format("timestamp")} AS "timestamp", feature, symbol, round(value - median(value) OVER (PARTITION BY "timestamp", feature), 6) AS residual FROM filled', (I.BARS, FILLED))
def trajectory_residual(spark, sf):
    f = _filled(spark, sf).withColumn("decision_time", F.lit("2024-01-31").cast("timestamp"))
    return rounded(trajectory.residuals(f).select(day("timestamp").alias("timestamp"), "feature", "symbol", "residual"), "residual")


@query(f"""SELECT {DAY.format('timestamp')} AS "timestamp", symbol, round(CASE WHEN count("close") OVER w = 5 THEN sum("close") OVER w END, 6) AS rolling FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY "timestamp" ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", (I.BARS,))
def rolling_sum(spark, sf):
    out = trajectory.rolling_sum(I.bars(spark, sf), 5, ["symbol"], value="close")
    return rounded(out.select(day("timestamp").alias("timestamp"), "symbol", "rolling"), "rolling")


@query(f"""SELECT {DAY.format('timestamp')} AS "timestamp", symbol, round(coalesce(CASE WHEN stddev_pop("close") OVER w > 1e-12 THEN ("close" - avg("close") OVER w) / stddev_pop("close") OVER w END, 0), 6) AS z FROM bars WINDOW w AS (PARTITION BY "timestamp")""", (I.BARS,))
def cross_zscore(spark, sf):
    return rounded(trajectory.cross_zscore(I.bars(spark, sf), "close", ["timestamp"]).select(day("timestamp").alias("timestamp"), "symbol", "z"), "z")


@query('SELECT symbol, "timestamp"::DATE::VARCHAR AS d, "close" FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY available_time DESC, "timestamp" DESC) = 1', (I.BARS,))
def latest_row(spark, sf):
    return trajectory.latest(I.bars(spark, sf), ["symbol"], ["available_time", "timestamp"]).select("symbol", F.to_date("timestamp").cast("string").alias("d"), "close")


@query("SELECT symbol, count(*) AS dimension, round(sqrt(sum(z * z)), 4) AS norm FROM (SELECT symbol, CASE WHEN s > 1e-12 THEN (value - m) / s ELSE 0 END AS z FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM filled WINDOW w AS (PARTITION BY symbol, feature))) GROUP BY symbol", (I.BARS, FILLED))
def trajectory_vectors(spark, sf):
    v = trajectory.vectors(trajectory.standardized(_filled(spark, sf), CELL), CELL)
    return v.select("symbol", F.size("vector").cast("long").alias("dimension"), F.round(F.sqrt(graph.dot(F.col("vector"), F.col("vector"))), 4).alias("norm"))


# ---- graphs on embeddings, one a label

LAYER = ["layer_id"]
TOPK = """
sims AS (
  SELECT a.label AS layer_id, a.vec_id AS src_id, b.vec_id AS dst_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
), topk AS (SELECT *, row_number() OVER (PARTITION BY layer_id, src_id ORDER BY similarity DESC, dst_id) AS rank FROM sims WHERE similarity >= 0.1 QUALIFY rank <= 8),
mutual AS (SELECT a.layer_id, a.src_id, a.dst_id, (a.similarity + b.similarity) / 2 AS weight, a.rank AS src_rank, b.rank AS dst_rank FROM topk a JOIN topk b ON a.layer_id = b.layer_id AND a.src_id = b.dst_id AND a.dst_id = b.src_id WHERE a.src_id < a.dst_id)"""


def _topk(spark, sf):
    return graph.directed_topk(I.vectors(spark, sf), LAYER, 8, 0.1)


def _mutual(spark, sf):
    return graph.reciprocal(_topk(spark, sf), LAYER)


@query("SELECT layer_id, src_id, dst_id, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM topk", (TOPK,))
def corr_topk(spark, sf):
    return rounded(_topk(spark, sf), "similarity")


@query("SELECT layer_id, src_id, dst_id, round(weight, 6) AS weight, src_rank::INTEGER AS src_rank, dst_rank::INTEGER AS dst_rank FROM mutual", (TOPK,))
def reciprocal_edges(spark, sf):
    return rounded(_mutual(spark, sf), "weight")


@query()
def capped_edges(spark, sf):
    return rounded(graph.degree_cap(_mutual(spark, sf), LAYER, 3), "weight")


SYM = "sym AS (SELECT layer_id, src_id AS node_id, dst_id AS other_id, weight FROM mutual UNION ALL SELECT layer_id, dst_id, src_id, weight FROM mutual)"
NODES = SYM + """,
nm AS (SELECT l.layer_id, v.vec_id AS node_id, count(s.weight) AS degree, coalesce(sum(s.weight), 0) AS strength FROM (SELECT DISTINCT layer_id FROM mutual) l CROSS JOIN embeddings v LEFT JOIN sym s ON s.layer_id = l.layer_id AND s.node_id = v.vec_id GROUP BY 1, 2)"""


def _nodes(spark, sf):
    return graph.node_metrics(_mutual(spark, sf), I.vectors(spark, sf).select("node_id"), LAYER)


@query("SELECT layer_id, node_id, degree, round(strength, 6) AS strength, round(CASE WHEN stddev_pop(strength) OVER w > 1e-12 THEN (strength - avg(strength) OVER w) / stddev_pop(strength) OVER w ELSE 0 END, 5) AS core_z FROM nm WINDOW w AS (PARTITION BY layer_id)", (TOPK, NODES))
def node_metrics(spark, sf):
    return rounded(rounded(_nodes(spark, sf), "strength"), "core_z", digits=5)


@query("SELECT s.layer_id, s.node_id, round(CASE WHEN sum(s.weight) <> 0 THEN sum(s.weight * (s.other_id % 7)) / sum(s.weight) ELSE 0 END, 6) AS neighbor_signal FROM sym s GROUP BY 1, 2", (TOPK, SYM))
def neighbor_mean(spark, sf):
    signals = I.vectors(spark, sf).select("node_id", (F.col("node_id") % 7).cast("double").alias("signal"))
    return rounded(graph.neighbor_mean(_mutual(spark, sf), signals, LAYER), "neighbor_signal")


@query(f"SELECT {DAY.format('decision_time')} AS decision_time, node_id, count(DISTINCT other_id) AS degree, round(sum(weight) / any_value(l), 6) AS strength, round(count(DISTINCT layer_id) / any_value(l), 6) AS layer_participation FROM (SELECT decision_time, layer_id, src_id AS node_id, dst_id AS other_id, weight FROM edges UNION ALL SELECT decision_time, layer_id, dst_id, src_id, weight FROM edges) JOIN (SELECT decision_time, count(DISTINCT layer_id) AS l FROM edges GROUP BY 1) USING (decision_time) GROUP BY 1, 2", (I.EDGES,))
def multiplex(spark, sf):
    out = graph.multiplex(I.edges(spark, sf)).withColumn("decision_time", day("decision_time"))
    return rounded(out, "strength", "layer_participation")


@query("""SELECT layer_id, round(quantile_cont(weight, 0.5), 6) AS weight_p50, round(quantile_cont(weight, 0.75), 6) AS weight_p75, round(quantile_cont(weight, 0.9), 6) AS weight_p90, round(any_value(p95), 6) AS weight_p95, round(quantile_cont(weight, 0.99), 6) AS weight_p99,
  round(avg(weight) FILTER (WHERE r <= greatest(1, ceil(n * 0.01))), 6) AS top_1pct_mean_weight, round(sum(weight) FILTER (WHERE weight >= p95) / sum(weight), 6) AS tail_mass_95
  FROM (SELECT *, quantile_cont(weight, 0.95) OVER (PARTITION BY layer_id) AS p95, count(*) OVER (PARTITION BY layer_id) AS n, row_number() OVER (PARTITION BY layer_id ORDER BY weight DESC) AS r FROM mutual) GROUP BY layer_id""", (TOPK,))
def weight_diagnostics(spark, sf):
    out = graph.weight_diagnostics(_mutual(spark, sf), LAYER)
    return rounded(out, *out.columns[1:])


@query("""SELECT layer_id, count(*) AS universe_count, count(*) FILTER (WHERE degree > 0) AS active_nodes, round(avg((degree > 0)::INTEGER), 6) AS node_coverage, round(avg((degree = 0)::INTEGER), 6) AS isolated_node_ratio, (sum(degree) / 2)::BIGINT AS edge_count,
  round(sum(degree) / 2 / greatest(1, count(*) * 8 / 2), 6) AS degree_cap_saturation, round(avg(degree), 6) AS mean_degree, round(avg(strength), 6) AS mean_strength FROM nm GROUP BY layer_id""", (TOPK, NODES))
def snapshot_qa(spark, sf):
    out = graph.snapshot_qa(_nodes(spark, sf), LAYER, 8)
    return rounded(out, "node_coverage", "isolated_node_ratio", "degree_cap_saturation", "mean_degree", "mean_strength")


def _codes_sql() -> str:
    table = graph.lsh_projection(64, 6)
    bits = " + ".join(f"(CASE WHEN list_dot_product(embedding::DOUBLE[], {[float(v) for v in table[:, b]]}::DOUBLE[]) > 0 THEN {1 << b} ELSE 0 END)" for b in range(6))
    return f"codes AS (SELECT label AS layer_id, vec_id AS node_id, {bits} AS code FROM embeddings)"


@query("SELECT layer_id, node_id, code::INTEGER AS code FROM codes", (_codes_sql(),))
def lsh_signature(spark, sf):
    return graph.lsh_codes(I.vectors(spark, sf), 64, 6).select("layer_id", "node_id", "code")


@query()
def lsh_edges(spark, sf):
    directed = graph.lsh_topk(graph.lsh_codes(I.vectors(spark, sf), 64, 6), LAYER, 6, 8, 0.1)
    return rounded(graph.reciprocal(directed, LAYER), "weight")


#: The bars' columns as two layers; a day stands for a minute.
BAR_LAYERS = (Layer(1, "return_corr_raw_1m", ("close",), "price", "return_corr_raw_1m", (15, 30)), Layer(4, "signed_flow", ("signed_flow", "n_events"), "trade_flow", "standard", (5, 15, 30)))


def _graphs_built(spark, sf):
    b = I.bars(spark, sf)
    symbols = b.select("symbol", F.col("symbol").alias("symbol_id")).distinct()
    grid = pit.decision_grid(b, "1 day")
    return build.build_graphs(b, grid, symbols, BuildConfig(), BAR_LAYERS, 86400), symbols, build.node_signals(b.withColumnRenamed("signed_flow", "signed_dollar_flow"), grid, symbols, 30, 86400)


@query()
def graph_build(spark, sf):
    edges = _graphs_built(spark, sf)[0].where("src_id is not null").drop("window_start", "window_end")
    return rounded(edges.withColumn("decision_time", day("decision_time")), "weight")


@query()
def graph_build_nodes(spark, sf):
    graphs, symbols, signals = _graphs_built(spark, sf)
    return rounded(build.build_nodes(graphs.persist(StorageLevel.DISK_ONLY), symbols, signals).withColumn("decision_time", day("decision_time")), "strength", "core_z", "neighbor_reversal", "neighbor_signed_flow")


@query()
def graph_build_snapshots(spark, sf):
    graphs, symbols, _ = _graphs_built(spark, sf)
    graphs = graphs.persist(StorageLevel.DISK_ONLY)
    out = build.build_snapshots(graphs, build.build_nodes(graphs, symbols), 1000, BAR_LAYERS).drop("window_start", "window_end")
    return out.withColumn("decision_time", day("decision_time"))


# ---- diagnostics on yearly edges

#: Linear quantiles.
THRESH = "th AS (SELECT layer_id, lookback_minutes, quantile_cont(weight, 0.8) AS q80, quantile_cont(weight, 0.9) AS q90, quantile_cont(weight, 0.95) AS q95 FROM edges GROUP BY 1, 2)"


@query("SELECT layer_id, lookback_minutes, round(q80, 6) AS q80, round(q90, 6) AS q90, round(q95, 6) AS q95 FROM th", (I.EDGES, THRESH))
def strong_thresholds(spark, sf):
    return rounded(diagnostics.strong_thresholds(I.edges(spark, sf)), "q80", "q90", "q95")


SNAP = """
ends AS (SELECT decision_time, layer_id, lookback_minutes, src_id AS node, weight FROM edges UNION ALL SELECT decision_time, layer_id, lookback_minutes, dst_id, weight FROM edges),
nodes AS (SELECT decision_time, layer_id, lookback_minutes, count(DISTINCT node) AS active_nodes, count(DISTINCT CASE WHEN weight >= q80 THEN node END) AS n80, count(DISTINCT CASE WHEN weight >= q90 THEN node END) AS n90, count(DISTINCT CASE WHEN weight >= q95 THEN node END) AS n95 FROM ends JOIN th USING (layer_id, lookback_minutes) GROUP BY 1, 2, 3),
snap AS (SELECT decision_time, layer_id, lookback_minutes, count(*) AS edge_count, any_value(active_nodes) AS active_nodes, any_value(active_nodes) / 200 AS node_coverage, 1 - any_value(active_nodes) / 200 AS isolated_node_ratio, avg(weight) AS weight_mean,
  avg((weight >= q80)::INTEGER) AS strong_edge_ratio_q80, avg((weight >= q90)::INTEGER) AS strong_edge_ratio_q90, avg((weight >= q95)::INTEGER) AS strong_edge_ratio_q95, any_value(n80) / 200 AS strong_node_coverage_q80, any_value(n90) / 200 AS strong_node_coverage_q90, any_value(n95) / 200 AS strong_node_coverage_q95
  FROM edges JOIN th USING (layer_id, lookback_minutes) JOIN nodes USING (decision_time, layer_id, lookback_minutes) GROUP BY 1, 2, 3),
tails AS (SELECT decision_time, layer_id, lookback_minutes, any_value(p90) AS weight_p90, any_value(p95) AS weight_p95, any_value(p99) AS weight_p99, avg(weight) FILTER (WHERE r <= greatest(1, ceil(n * 0.01))) AS top_1pct_mean_weight, sum(weight) FILTER (WHERE weight >= p95) / sum(weight) AS tail_mass_95
  FROM (SELECT *, quantile_cont(weight, 0.9) OVER w AS p90, quantile_cont(weight, 0.95) OVER w AS p95, quantile_cont(weight, 0.99) OVER w AS p99, count(*) OVER w AS n, row_number() OVER (w ORDER BY weight DESC) AS r FROM edges WINDOW w AS (PARTITION BY decision_time, layer_id, lookback_minutes)) GROUP BY 1, 2, 3)"""
SHARES = ("node_coverage", "isolated_node_ratio", "weight_mean", *(f"strong_{k}_{q}" for k in ("edge_ratio", "node_coverage") for q in ("q80", "q90", "q95")))


def _snapshots(spark, sf):
    e = I.edges(spark, sf)
    return diagnostics.snapshot_diagnostics(e, 200, diagnostics.strong_thresholds(e))


def _weights(spark, sf):
    return _snapshots(spark, sf).join(graph.weight_diagnostics(I.edges(spark, sf), G), G)


@query(f"SELECT {DAY.format('decision_time')} AS decision_time, layer_id, lookback_minutes, edge_count, active_nodes, {', '.join(f'round({c}, 6) AS {c}' for c in SHARES)} FROM snap", (I.EDGES, THRESH, SNAP))
def snapshot_diagnostics(spark, sf):
    return rounded(_snapshots(spark, sf).withColumn("decision_time", day("decision_time")), *SHARES)


#: All pairs and strong ones (q90) frame by frame, nulls in the first.
TEMP = """
fp AS (SELECT decision_time, layer_id, lookback_minutes, src_id, dst_id, weight >= q90 AS s FROM edges JOIN th USING (layer_id, lookback_minutes)),
fr AS (SELECT *, lag(decision_time) OVER w AS p, lag(a_now) OVER w AS a_old, lag(s_now) OVER w AS s_old FROM (SELECT decision_time, layer_id, lookback_minutes, count(*) AS a_now, count(*) FILTER (WHERE s) AS s_now FROM fp GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY layer_id, lookback_minutes ORDER BY decision_time)),
kept AS (SELECT e.decision_time, e.layer_id, count(*) AS a_kept, count(*) FILTER (WHERE e.s AND o.s) AS s_kept FROM fp e JOIN fr USING (decision_time, layer_id, lookback_minutes) JOIN fp o ON o.decision_time = fr.p AND o.layer_id = e.layer_id AND o.src_id = e.src_id AND o.dst_id = e.dst_id GROUP BY 1, 2),
temp AS (SELECT fr.*, CASE WHEN p IS NOT NULL THEN coalesce(a_kept, 0) END AS a, CASE WHEN p IS NOT NULL THEN coalesce(s_kept, 0) END AS s FROM fr LEFT JOIN kept USING (decision_time, layer_id)),
tr AS (SELECT decision_time, layer_id, lookback_minutes, (a_now - a) / greatest(1, a_now) AS all_birth_rate, (a_old - a) / greatest(1, a_old) AS all_death_rate, a / greatest(1, a_old) AS all_persistence, a / greatest(1, a_now + a_old - a) AS all_jaccard,
  (s_now - s) / greatest(1, s_now) AS strong_birth_rate, (s_old - s) / greatest(1, s_old) AS strong_death_rate, s / greatest(1, s_old) AS strong_persistence, s / greatest(1, s_now + s_old - s) AS strong_jaccard FROM temp)"""
RATES = tuple(f"{k}_{r}" for k in ("all", "strong") for r in ("birth_rate", "death_rate", "persistence", "jaccard"))


def _temporal(spark, sf):
    e = I.edges(spark, sf)
    return diagnostics.temporal_diagnostics(e, diagnostics.strong_thresholds(e))


@query(f"SELECT {DAY.format('decision_time')} AS decision_time, layer_id, lookback_minutes, {', '.join(f'round({c}, 6) AS {c}' for c in RATES)} FROM tr", (I.EDGES, THRESH, TEMP))
def temporal_diagnostics(spark, sf):
    return rounded(_temporal(spark, sf).withColumn("decision_time", day("decision_time")), *RATES)


#: Pairs and nodes by the layers and families that hold them.
RES = """
rl AS (SELECT decision_time, layer_id, src_id, dst_id, CASE layer_id WHEN 1 THEN 'price' ELSE 'activity' END AS family FROM edges WHERE layer_id <> 0),
rp AS (SELECT decision_time, src_id, dst_id, count(DISTINCT layer_id) AS l, count(DISTINCT family) AS f FROM rl GROUP BY 1, 2, 3),
rn AS (SELECT decision_time, node, count(DISTINCT layer_id) AS l, count(DISTINCT family) AS f FROM (SELECT *, src_id AS node FROM rl UNION ALL SELECT *, dst_id FROM rl) GROUP BY 1, 2),
res AS (SELECT * FROM (SELECT decision_time, count(*) FILTER (WHERE l >= 2) AS resonant_edges_ge2_layers, count(*) FILTER (WHERE l >= 3) AS resonant_edges_ge3_layers, count(*) FILTER (WHERE f >= 2) AS resonant_edges_ge2_families, count(*) FILTER (WHERE f >= 3) AS resonant_edges_ge3_families, avg(l) AS mean_edge_layer_support FROM rp GROUP BY 1)
  JOIN (SELECT decision_time, count(*) FILTER (WHERE l >= 5) AS core_nodes_ge5_layers, count(*) FILTER (WHERE f >= 3) AS core_nodes_ge3_families, avg(l) AS mean_node_layer_participation FROM rn GROUP BY 1) USING (decision_time))"""


def _resonance(spark, sf):
    return diagnostics.resonance(I.edges(spark, sf), spark.createDataFrame(I.FAMILIES, "layer_id int, family string"))


@query(f"SELECT {DAY.format('decision_time')} AS decision_time, {', '.join(c if c.endswith(('layers', 'families')) else f'round({c}, 6) AS {c}' for c in diagnostics.RESONANCE_METRICS)} FROM res", (I.EDGES, RES))
def resonance(spark, sf):
    return rounded(_resonance(spark, sf).withColumn("decision_time", day("decision_time")), "mean_edge_layer_support", "mean_node_layer_participation")


_DAILY = (diagnostics.SNAPSHOT_METRICS[:9], diagnostics.TEMPORAL_METRICS, diagnostics.RESONANCE_METRICS)


@query(f"""SELECT {DAY.format('decision_time')} AS trade_date, {', '.join(f'round({c}, 5) AS {c}' for cs in _DAILY for c in cs)} FROM (SELECT decision_time, {', '.join(f'avg({c}) AS {c}' for c in _DAILY[0])} FROM snap JOIN tails USING (decision_time, layer_id, lookback_minutes) GROUP BY 1)
  FULL JOIN (SELECT decision_time, {', '.join(f'avg({c}) AS {c}' for c in _DAILY[1])} FROM tr GROUP BY 1) USING (decision_time) FULL JOIN (SELECT decision_time, {', '.join(f'avg({c}) AS {c}' for c in _DAILY[2])} FROM res GROUP BY 1) USING (decision_time)""", (I.EDGES, THRESH, SNAP, TEMP, RES))
def daily_diagnostics(spark, sf):
    dated = lambda df: df.withColumn("trade_date", day("decision_time"))
    out = diagnostics.daily(dated(_weights(spark, sf)), dated(_temporal(spark, sf)), dated(_resonance(spark, sf)))
    return rounded(out, *out.columns[1:], digits=5)


COMP = """
sides AS (SELECT decision_time, layer_id, src_id AS a, dst_id AS b FROM edges UNION ALL SELECT decision_time, layer_id, dst_id, src_id FROM edges),
reach AS (SELECT decision_time, layer_id, a AS node, least(a, min(b)) AS label FROM sides GROUP BY 1, 2, 3 UNION SELECT e.decision_time, e.layer_id, e.b, r.label FROM reach r JOIN sides e ON e.decision_time = r.decision_time AND e.layer_id = r.layer_id AND e.a = r.node WHERE r.label < e.b),
comp AS (SELECT decision_time, layer_id, node AS node_id, min(label) AS component_id FROM reach GROUP BY 1, 2, 3)"""


def _components(spark, sf):
    return diagnostics.graph_components(I.edges(spark, sf), ["decision_time", "layer_id"])


@query(f"SELECT {DAY.format('decision_time')} AS decision_time, layer_id, node_id, component_id FROM comp", ("RECURSIVE " + I.EDGES.strip(), COMP))
def graph_components(spark, sf):
    return _components(spark, sf).withColumn("decision_time", day("decision_time"))


@query(f"SELECT {DAY.format('decision_time')} AS decision_time, layer_id, count(*) AS component_count, round(max(n) / 200, 6) AS giant_component_coverage, round(sum(n * n) / (sum(n) * sum(n)), 6) AS component_size_hhi FROM (SELECT decision_time, layer_id, component_id, count(*) AS n FROM comp GROUP BY 1, 2, 3) GROUP BY 1, 2", ("RECURSIVE " + I.EDGES.strip(), COMP))
def component_metrics(spark, sf):
    m = diagnostics.component_metrics(_components(spark, sf), ["decision_time", "layer_id"], 200)
    return rounded(m.withColumn("decision_time", day("decision_time")), "giant_component_coverage", "component_size_hhi")


@query(f"""SELECT {DAY.format('decision_time')} AS decision_time, layer_id, any_value(community_count) AS community_count, round(any_value(hhi), 6) AS community_hhi, round(any_value(top), 6) AS top_community_coverage, round(sum(within / m - (degree / (2 * m)) * (degree / (2 * m))), 6) AS weighted_modularity, round(2 * sum(within - n * (n - 1) / 2), 4) AS cpm_quality, round(sum(within / m), 6) AS within_community_weight_ratio FROM (
  SELECT *, sum(degree) OVER g / 2 AS m, count(*) OVER g AS community_count, sum(n * n) OVER g / (sum(n) OVER g * sum(n) OVER g) AS hhi, max(n) OVER g / 200 AS top FROM (SELECT decision_time, layer_id, c, sum(weight) AS degree, sum(w) AS within, count(DISTINCT node) AS n FROM (
    SELECT decision_time, layer_id, src_id % 10 AS c, src_id AS node, weight, CASE WHEN src_id % 10 = dst_id % 10 THEN weight ELSE 0 END AS w FROM edges UNION ALL SELECT decision_time, layer_id, dst_id % 10, dst_id, weight, 0 FROM edges) GROUP BY 1, 2, 3) WINDOW g AS (PARTITION BY decision_time, layer_id)) GROUP BY 1, 2""", (I.EDGES,))
def modularity(spark, sf):
    e = I.edges(spark, sf)
    group = ["decision_time", "layer_id"]
    m = e.select(*group, F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct().withColumn("community_id", F.col("node_id") % 10)
    out = diagnostics.community_metrics(e, m, group, 200).withColumn("decision_time", day("decision_time"))
    return rounded(rounded(out, "community_hhi", "top_community_coverage", "weighted_modularity", "within_community_weight_ratio"), "cpm_quality", digits=4)


#: Two candidates, the graphs of even and of odd years. Means, regime separation, z and score.
_GOOD, _REGIME = ("strong_edge_ratio_q90", "strong_node_coverage_q90", "weight_p95", "weight_p99", "strong_persistence"), ("strong_edge_ratio_q90", "strong_node_coverage_q90", "weight_p95", "weight_p99", "tail_mass_95", "node_coverage", "strong_birth_rate", "strong_death_rate", "strong_persistence")
_LATE = "decision_time >= TIMESTAMP '1996-01-01'"


def _z_sql(c: str) -> str:
    return f"({c} - avg({c}) OVER w) / CASE WHEN stddev_pop({c}) OVER w > 0 THEN stddev_pop({c}) OVER w ELSE 1 END"


def _effect_sql(c: str) -> str:
    return f"CASE WHEN stddev_samp({c}) > 0 THEN abs(avg({c}) FILTER (WHERE {_LATE}) - avg({c}) FILTER (WHERE NOT ({_LATE}))) / stddev_samp({c}) END"


CAND = f"""
cand AS (SELECT 'c' || year(decision_time) % 2 AS candidate, *, edge_count / greatest(1.0 * 30 / 2, 1) AS degree_cap_saturation, (edge_count = 0)::INTEGER::DOUBLE AS empty_rate FROM snap JOIN tails USING (decision_time, layer_id, lookback_minutes) JOIN tr USING (decision_time, layer_id, lookback_minutes)),
runs AS (SELECT candidate, layer_id, lookback_minutes, {', '.join(f'avg({c}) AS {c}' for c in (*_GOOD, 'degree_cap_saturation', 'empty_rate'))}, coalesce(list_avg([{', '.join(_effect_sql(c) for c in _REGIME)}]), 0) AS regime_separation FROM cand GROUP BY 1, 2, 3),
scored AS (SELECT candidate, layer_id, lookback_minutes, regime_separation, list_avg([{', '.join(_z_sql(c) for c in (*_GOOD, 'regime_separation'))}]) AS reward_score, list_avg([{', '.join(_z_sql(c) for c in diagnostics.BAD_METRICS)}]) AS penalty_score FROM runs WINDOW w AS (PARTITION BY layer_id, lookback_minutes))"""
SCORE = "round(reward_score - 0.75 * penalty_score, 4) AS multiobjective_score"


def _scored(spark, sf):
    dated = lambda df: df.withColumn("trade_date", day("decision_time"))
    rows = diagnostics.candidate_rows(dated(_weights(spark, sf)), dated(_temporal(spark, sf)), "", {"top_k": 30, "degree_cap": 30, "minimum_similarity": 0.0})
    days = [r[0] for r in dated(I.edges(spark, sf)).select("trade_date").distinct().collect()]
    rows = rows.withColumn("candidate", F.concat(F.lit("c"), (F.year("decision_time") % 2).cast("string")))
    return diagnostics.candidate_scores(rows, [d for d in days if d >= "1996"], [d for d in days if d < "1996"])


@query(f"SELECT candidate, layer_id, lookback_minutes, round(regime_separation, 4) AS regime_separation, round(reward_score, 4) AS reward_score, round(penalty_score, 4) AS penalty_score, {SCORE} FROM scored", (I.EDGES, THRESH, SNAP, TEMP, CAND))
def candidate_scores(spark, sf):
    columns = ("regime_separation", "reward_score", "penalty_score", "multiobjective_score")
    return rounded(_scored(spark, sf).select("candidate", "layer_id", "lookback_minutes", *columns), *columns, digits=4)


@query(f"SELECT layer_id, candidate, {SCORE} FROM scored QUALIFY row_number() OVER (PARTITION BY layer_id, lookback_minutes ORDER BY reward_score - 0.75 * penalty_score DESC, candidate) = 1", (I.EDGES, THRESH, SNAP, TEMP, CAND))
def best_candidates(spark, sf):
    return rounded(diagnostics.best_candidates(_scored(spark, sf)).select("layer_id", "candidate", "multiobjective_score"), "multiobjective_score", digits=4)


@query("SELECT layer_id, round(abs(avg(edge_count) FILTER (WHERE y >= 1998) - avg(edge_count) FILTER (WHERE y < 1998)) / nullif(stddev_samp(edge_count), 0), 6) AS effect_size FROM (SELECT *, year(decision_time) AS y FROM snap) GROUP BY 1", (I.EDGES, THRESH, SNAP))
def effect_size(spark, sf):
    rows = _snapshots(spark, sf).withColumn("late", F.year("decision_time") >= 1998)
    return rounded(diagnostics.effect_size(rows, "edge_count", "late", ["layer_id"]), "effect_size")


# ---- forests and relations

FCELL = ["decision_time", "layer_id", "scale"]
PAIRS = """
fe AS (SELECT decision_time, layer_id, '30' AS scale, src_id, dst_id, weight FROM edges),
pairs AS (SELECT decision_time, layer_id, scale, least(src_id, dst_id) AS a, greatest(src_id, dst_id) AS b, max(abs(coalesce(weight, 0))) AS weight FROM fe WHERE src_id <> dst_id GROUP BY 1, 2, 3, 4, 5)"""
LEAVES = "leaves AS (SELECT DISTINCT decision_time, layer_id, scale, 'L' || lpad((m // 10)::VARCHAR, 2, '0') AS theme_id, m AS member_id FROM (SELECT *, a AS m FROM pairs UNION ALL SELECT *, b FROM pairs))"


def _pairs(spark, sf):
    return forest.compact_pairs(normalized_edges(I.edges(spark, sf)).withColumn("scale", F.lit("30")))


def _leaves(pairs):
    m = pairs.select(*FCELL, F.explode(F.array("a", "b")).alias("member_id")).distinct()
    return m.withColumn("theme_id", F.concat(F.lit("L"), F.lpad(F.floor(F.col("member_id") / 10).cast("string"), 2, "0")))


@query(f"SELECT {DAY.format('decision_time')} AS decision_time, layer_id, a, b, round(weight, 6) AS weight FROM pairs", (I.EDGES, PAIRS))
def pair_compaction(spark, sf):
    return rounded(_pairs(spark, sf).withColumn("decision_time", day("decision_time")).drop("scale"), "weight")


DEG = "deg AS (SELECT decision_time, layer_id, scale, m AS member_id, sum(weight) AS degree FROM (SELECT *, a AS m FROM pairs UNION ALL SELECT *, b FROM pairs) GROUP BY 1, 2, 3, 4)"


@query(f"SELECT {DAY.format('decision_time')} AS decision_time, layer_id, member_id, round(degree, 6) AS degree FROM deg", (I.EDGES, PAIRS, DEG))
def weighted_degree(spark, sf):
    out = forest.weighted_degree(_pairs(spark, sf)).withColumn("decision_time", day("decision_time")).drop("scale")
    return rounded(out, "degree", digits=6)


@query(f"SELECT {DAY.format('decision_time')} AS decision_time, layer_id, theme_id, member_id, row_number() OVER (w ORDER BY round(degree, 6) DESC, member_id) AS rank_in_theme, round(round(degree, 6) / max(round(degree, 6)) OVER w, 9) AS core_score FROM leaves JOIN deg USING (decision_time, layer_id, scale, member_id) WINDOW w AS (PARTITION BY decision_time, layer_id, theme_id)", (I.EDGES, PAIRS, LEAVES, DEG))
def ranked_members(spark, sf):
    p = _pairs(spark, sf)
    out = forest.ranked_members(_leaves(p), rounded(forest.weighted_degree(p), "degree", digits=6), [*FCELL, "theme_id"])
    return rounded(out.withColumn("decision_time", day("decision_time")).drop("scale", "degree"), "core_score", digits=9)


RELATIONS = """
re AS (SELECT p.*, x.theme_id AS s, y.theme_id AS t FROM pairs p JOIN leaves x ON x.decision_time = p.decision_time AND x.layer_id = p.layer_id AND x.member_id = p.a JOIN leaves y ON y.decision_time = p.decision_time AND y.layer_id = p.layer_id AND y.member_id = p.b),
ri AS (SELECT decision_time, layer_id, s AS theme_id, sum(weight) AS w FROM re WHERE s = t GROUP BY 1, 2, 3),
ra AS (SELECT decision_time, layer_id, least(s, t) AS src_theme_id, greatest(s, t) AS dst_theme_id, sum(weight) AS inter_leaf_weight, count(*) AS edge_count FROM re WHERE s <> t GROUP BY 1, 2, 3, 4),
rn AS (SELECT ra.*, inter_leaf_weight / sqrt(greatest(coalesce(i.w, 0), 1e-12) * greatest(coalesce(j.w, 0), 1e-12)) AS normalized_weight FROM ra
  LEFT JOIN ri i ON i.decision_time = ra.decision_time AND i.layer_id = ra.layer_id AND i.theme_id = src_theme_id LEFT JOIN ri j ON j.decision_time = ra.decision_time AND j.layer_id = ra.layer_id AND j.theme_id = dst_theme_id),
rel AS (SELECT *, least(1, normalized_weight / 0.25) AS relation_strength, normalized_weight >= 0.25 AS hard_keep FROM rn WHERE normalized_weight >= 0.25 OR normalized_weight / 0.25 >= 0.15)"""


@query(f"SELECT {DAY.format('decision_time')} AS decision_time, layer_id, src_theme_id, dst_theme_id, round(relation_strength, 4) AS relation_strength, CASE WHEN relation_strength >= 0.6 THEN 'strong' WHEN relation_strength >= 0.35 THEN 'medium' ELSE 'weak' END AS relation_tier, hard_keep, edge_count FROM rel", (I.EDGES, PAIRS, LEAVES, RELATIONS))
def relation_edges(spark, sf):
    p = _pairs(spark, sf)
    out = forest.relation_edges(p, _leaves(p)).withColumn("decision_time", day("decision_time"))
    return rounded(out.select("decision_time", "layer_id", "src_theme_id", "dst_theme_id", "relation_strength", "relation_tier", "hard_keep", "edge_count"), "relation_strength", digits=4)


@query(f"SELECT {DAY.format('decision_time')} AS decision_time, layer_id, count(*) AS leaf_count, max(n) AS leaf_max, quantile_cont(n, 0.5) AS leaf_median, round(quantile_cont(n, 0.9), 6) AS leaf_p90 FROM (SELECT decision_time, layer_id, theme_id, count(*) AS n FROM leaves GROUP BY 1, 2, 3) GROUP BY 1, 2", (I.EDGES, PAIRS, LEAVES))
def leaf_stats(spark, sf):
    out = forest.leaf_stats(_leaves(_pairs(spark, sf)), FCELL).withColumn("decision_time", day("decision_time")).drop("scale")
    return rounded(out, "leaf_p90")


CONT = """
tl AS (SELECT DISTINCT decision_time, layer_id, 'T' || (member_id * 7 + year(decision_time)) % 13 AS theme_id, member_id FROM leaves),
tt AS (SELECT layer_id, decision_time, lead(decision_time) OVER (PARTITION BY layer_id ORDER BY decision_time) AS dst_time FROM (SELECT DISTINCT layer_id, decision_time FROM tl)),
tsz AS (SELECT layer_id, decision_time, theme_id, count(*) AS n FROM tl GROUP BY 1, 2, 3),
tov AS (SELECT a.layer_id, a.decision_time AS src_time, t.dst_time, a.theme_id AS src_theme_id, b.theme_id AS dst_theme_id, count(*) AS overlap FROM tl a JOIN tt t ON t.layer_id = a.layer_id AND t.decision_time = a.decision_time JOIN tl b ON b.layer_id = a.layer_id AND b.decision_time = t.dst_time AND b.member_id = a.member_id GROUP BY 1, 2, 3, 4, 5),
tj AS (SELECT o.*, overlap / (x.n + y.n - overlap) AS jaccard, overlap / least(x.n, y.n) AS containment FROM tov o JOIN tsz x ON x.layer_id = o.layer_id AND x.decision_time = src_time AND x.theme_id = src_theme_id JOIN tsz y ON y.layer_id = o.layer_id AND y.decision_time = dst_time AND y.theme_id = dst_theme_id),
tb AS (SELECT *, greatest(jaccard, 0.7::DOUBLE * jaccard + 0.3::DOUBLE * containment) AS strength FROM tj QUALIFY row_number() OVER (PARTITION BY layer_id, src_time, src_theme_id ORDER BY greatest(jaccard, 0.7::DOUBLE * jaccard + 0.3::DOUBLE * containment) DESC, dst_theme_id) = 1)"""


@query(f"SELECT layer_id, {DAY.format('src_time')} AS src_time, {DAY.format('dst_time')} AS dst_time, src_theme_id, dst_theme_id, overlap, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment, round(strength, 6) AS continuation_strength, jaccard >= 0.25 AS hard_continue, strength >= 0.15 AS fuzzy_continue FROM tb WHERE strength >= 0.15 OR jaccard >= 0.25", (I.EDGES, PAIRS, LEAVES, CONT))
def theme_continuation(spark, sf):
    m = _leaves(_pairs(spark, sf)).withColumn("theme_id", F.concat(F.lit("T"), ((F.col("member_id") * 7 + F.year("decision_time")) % 13).cast("string")))
    out = forest.continuation(m, ["layer_id"])
    return rounded(out.withColumns({"src_time": day("src_time"), "dst_time": day("dst_time")}), "jaccard", "containment", "continuation_strength")


@query()
def theme_forest(spark, sf):
    return forest.build_forest(_pairs(spark, sf)).withColumn("decision_time", day("decision_time"))


# ---- alpha


def _labels(spark, sf):
    return alpha.past_labels(I.labels(spark, sf), [1, 2], 1, "DAYS")


#: The label that began horizon + bar before, not the one that began a horizon before, which ends a bar ahead.
PAST = I.LABELS + """,
pl AS (SELECT l.*, p.label_1 AS past_label_1, q.label_2 AS past_label_2 FROM labels l LEFT JOIN labels p ON p.symbol = l.symbol AND p.decision_time = l.decision_time - INTERVAL 2 DAY LEFT JOIN labels q ON q.symbol = l.symbol AND q.decision_time = l.decision_time - INTERVAL 3 DAY)"""


@query(f"SELECT {DAY.format('decision_time')} AS decision_time, symbol, label_1, label_2, past_label_1, past_label_2 FROM pl", (PAST,))
def past_labels(spark, sf):
    return _labels(spark, sf).withColumn("decision_time", day("decision_time")).select("decision_time", "symbol", "label_1", "label_2", "past_label_1", "past_label_2")


_LABELS = {"label_1": "ret_{}_1", "label_2": "ret_{}_2", "past_label_1": "past_{}_1", "past_label_2": "past_{}_2"}
_MEANS = [n.format(k) for n in _LABELS.values() for k in ("eq", "core", "top5", "top10")]


def _returns_sql(c: str, name: str) -> str:
    return f"avg({c}) AS {name.format('eq')}, coalesce(sum(core_score * {c}), 0) / nullif(sum(core_score), 0) AS {name.format('core')}, avg({c}) FILTER (WHERE r <= 5) AS {name.format('top5')}, avg({c}) FILTER (WHERE r <= 10) AS {name.format('top10')}"


#: All horizons, past and future, the weighted mean over all scores.
RETURNS = f"""
trr AS (SELECT decision_time, layer_id, scale, level, theme_id, count(*) AS member_count, {', '.join(_returns_sql(c, n) for c, n in _LABELS.items())} FROM
  (SELECT m.*, label_1, label_2, past_label_1, past_label_2, row_number() OVER (PARTITION BY m.decision_time, m.theme_id ORDER BY core_score DESC, member_id) AS r FROM members m JOIN pl l ON l.symbol = m.member_id AND l.decision_time = m.decision_time) GROUP BY 1, 2, 3, 4, 5)"""


def _returns(spark, sf):
    return alpha.theme_returns(I.members(spark, sf), _labels(spark, sf))


@query(f"SELECT {DAY.format('decision_time')} AS decision_time, theme_id, member_count, {', '.join(f'round({c}, 9) AS {c}' for c in _MEANS)} FROM trr", (PAST, I.MEMBERS, RETURNS))
def theme_returns(spark, sf):
    return rounded(_returns(spark, sf).withColumn("decision_time", day("decision_time")).drop("layer_id", "scale", "level"), *_MEANS, digits=9)


def _spillover(spark, sf):
    key = alpha.THEME[:-1]
    t = I.members(spark, sf).select(*key, "theme_id").distinct()
    rel = t.withColumnRenamed("theme_id", "src_theme_id").join(t.withColumnRenamed("theme_id", "dst_theme_id"), key).where("src_theme_id < dst_theme_id").withColumn("relation_strength", (F.substring("src_theme_id", 2, 1).cast("int") + 1) / 10.0)
    return alpha.spillover(rel, _returns(spark, sf), "past_eq_1", ["ret_eq_1", "ret_eq_2"])


SPILL = """
th2 AS (SELECT DISTINCT decision_time, theme_id FROM members),
spill AS (SELECT s.decision_time, d.theme_id AS dst_theme_id, avg((substr(s.theme_id, 2, 1)::INTEGER + 1) / 10 * coalesce(p.past_eq_1, 0)) AS signal, avg((substr(s.theme_id, 2, 1)::INTEGER + 1) / 10) AS mean_strength, count(*) AS source_count, any_value(f.ret_eq_1) AS target_1, any_value(f.ret_eq_2) AS target_2
  FROM th2 s JOIN th2 d ON s.decision_time = d.decision_time AND s.theme_id < d.theme_id JOIN trr p ON p.decision_time = s.decision_time AND p.theme_id = s.theme_id JOIN trr f ON f.decision_time = d.decision_time AND f.theme_id = d.theme_id GROUP BY 1, 2)"""


@query(f"SELECT {DAY.format('decision_time')} AS decision_time, dst_theme_id, round(signal, 9) AS signal, round(mean_strength, 9) AS mean_strength, source_count, round(target_1, 9) AS target_1, round(target_2, 9) AS target_2 FROM spill", (PAST, I.MEMBERS, RETURNS, SPILL))
def spillover(spark, sf):
    out = _spillover(spark, sf).withColumn("decision_time", day("decision_time")).drop("layer_id", "scale", "level")
    return rounded(out, "signal", "mean_strength", "target_1", "target_2", digits=9)


@query(f"""SELECT {DAY.format('decision_time')} AS decision_time, theme_id, any_value(n) AS member_count, round(avg(p) FILTER (WHERE r < greatest(1, floor(n * 0.2))), 10) AS core_past, round(avg(x) FILTER (WHERE r >= n - greatest(1, floor(n * 0.5))), 10) AS peripheral_future,
  round(avg(p) FILTER (WHERE r < greatest(1, floor(n * 0.2))) * (max(core_score) - avg(core_score) FILTER (WHERE r >= n - greatest(1, floor(n * 0.5)))), 10) AS signal
  FROM (SELECT m.*, label_1 AS x, past_label_1 AS p, count(*) OVER (PARTITION BY m.decision_time, theme_id) AS n, row_number() OVER (PARTITION BY m.decision_time, theme_id ORDER BY core_score DESC, member_id) - 1 AS r FROM members m JOIN pl ON symbol = member_id AND pl.decision_time = m.decision_time) WHERE n >= 5 GROUP BY 1, 2""", (PAST, I.MEMBERS))
def core_peripheral(spark, sf):
    out = alpha.core_peripheral(I.members(spark, sf), _labels(spark, sf), "label_1").withColumn("decision_time", day("decision_time")).drop("layer_id", "scale", "level")
    return rounded(out, "core_past", "peripheral_future", "signal", digits=10)


IC = """
icr AS (SELECT decision_time, symbol % 2 AS side, past_label_1 AS s, label_1 AS t FROM pl WHERE past_label_1 IS NOT NULL AND label_1 IS NOT NULL),
icq AS (SELECT *, quantile_cont(s, 0.8) OVER w AS q80, quantile_cont(s, 0.2) OVER w AS q20, rank() OVER (w ORDER BY s) + (count(*) OVER (PARTITION BY decision_time, side, s) - 1) / 2 AS a, rank() OVER (w ORDER BY t) + (count(*) OVER (PARTITION BY decision_time, side, t) - 1) / 2 AS b FROM icr WINDOW w AS (PARTITION BY decision_time, side)),
ic AS (SELECT decision_time, side, count(*) AS n, corr(a, b) AS rank_ic, avg(t) FILTER (WHERE s >= q80) AS top_mean, avg(t) FILTER (WHERE s <= q20) AS bottom_mean, avg((s * t > 0)::INTEGER) AS hit_rate FROM icq GROUP BY 1, 2 HAVING count(*) >= 20 AND count(DISTINCT s) >= 3)"""


def _ic(spark, sf):
    return alpha.rank_ic(_labels(spark, sf).withColumn("side", F.col("symbol") % 2), ["decision_time", "side"], "past_label_1", "label_1")


@query(f"SELECT {DAY.format('decision_time')} AS decision_time, side, n, round(rank_ic, 9) AS rank_ic, round(top_mean, 9) AS top_mean, round(bottom_mean, 9) AS bottom_mean, round(hit_rate, 9) AS hit_rate, round(top_mean - bottom_mean, 9) AS spread FROM ic", (PAST, IC))
def rank_ic(spark, sf):
    return rounded(_ic(spark, sf).withColumn("decision_time", day("decision_time")), "rank_ic", "top_mean", "bottom_mean", "hit_rate", "spread", digits=9)


@query("""SELECT side, sum(n)::BIGINT AS n, round(sum(coalesce(rank_ic, 0) * n) / sum(n), 5) AS rank_ic, round(sum(coalesce(top_mean - bottom_mean, 0) * n) / sum(n), 5) AS spread, round(avg((coalesce(rank_ic, 0) > 0)::INTEGER), 5) AS positive_date_ratio,
  round(CASE WHEN count(*) >= 2 THEN avg(coalesce(rank_ic, 0)) / (stddev_samp(coalesce(rank_ic, 0)) / sqrt(count(*))) END, 4) AS t_stat FROM ic GROUP BY side""", (PAST, IC))
def alpha_summary(spark, sf):
    return rounded(rounded(alpha.alpha_summary(_ic(spark, sf), ["side"], "decision_time"), "rank_ic", "spread", "positive_date_ratio", digits=5), "t_stat", digits=4)


#: Births have no predecessor; by the letter, no earlier row of the id.
BIRTH = """
tlm AS (SELECT decision_time, 't' || (member_id + day(decision_time)) % 10 AS theme_id, member_id FROM members),
tls AS (SELECT decision_time, theme_id, count(*) AS n FROM tlm GROUP BY 1, 2),
tln AS (SELECT decision_time, lead(decision_time) OVER (ORDER BY decision_time) AS nxt FROM (SELECT DISTINCT decision_time FROM tlm)),
tlo AS (SELECT a.decision_time, nxt, a.theme_id AS s, b.theme_id AS d, count(*) AS o FROM tlm a JOIN tln USING (decision_time) JOIN tlm b ON b.decision_time = nxt AND b.member_id = a.member_id GROUP BY 1, 2, 3, 4),
tlj AS (SELECT tlo.*, o / (x.n + y.n - o) AS j, o / least(x.n, y.n) AS c FROM tlo JOIN tls x ON x.decision_time = tlo.decision_time AND x.theme_id = s JOIN tls y ON y.decision_time = nxt AND y.theme_id = d),
tlc AS (SELECT nxt AS decision_time, d AS theme_id FROM (SELECT *, greatest(j, 0.7::DOUBLE * j + 0.3::DOUBLE * c) AS v FROM tlj QUALIFY row_number() OVER (PARTITION BY decision_time, s ORDER BY greatest(j, 0.7::DOUBLE * j + 0.3::DOUBLE * c) DESC, d) = 1) WHERE v >= 0.15 OR j >= 0.25),
tlr AS (SELECT m.decision_time, theme_id, avg(label_1) AS x FROM tlm m JOIN pl l ON l.symbol = m.member_id AND l.decision_time = m.decision_time GROUP BY 1, 2)"""


@query(f"""SELECT {DAY.format('decision_time')} AS decision_time, count(*) FILTER (WHERE b) AS born, round(avg(x) FILTER (WHERE b), 9) AS born_return, round(avg(x) FILTER (WHERE NOT b), 9) AS old_return, round(avg(x) FILTER (WHERE b) - avg(x) FILTER (WHERE NOT b), 9) AS excess
  FROM (SELECT *, (decision_time, theme_id) NOT IN (SELECT (decision_time, theme_id) FROM tlc) AS b FROM tlr) GROUP BY 1""", (PAST, I.MEMBERS, BIRTH))
def theme_birth(spark, sf):
    m = I.members(spark, sf).withColumn("theme_id", F.concat(F.lit("t"), ((F.col("member_id") + F.dayofmonth("decision_time")) % 10).cast("string")))
    born = alpha.births(alpha.theme_returns(m, I.labels(spark, sf)), forest.continuation(m, ["layer_id"]), ["layer_id"])
    return rounded(alpha.theme_birth(born, "ret_eq_1").withColumn("decision_time", day("decision_time")), "born_return", "old_return", "excess", digits=9)


@query(f"""SELECT {DAY.format('decision_time')} AS decision_time, count(*) FILTER (WHERE f = decision_time) AS born, round(avg(ret_eq_1) FILTER (WHERE f = decision_time), 9) AS born_return, round(avg(ret_eq_1) FILTER (WHERE f <> decision_time), 9) AS old_return,
  round(avg(ret_eq_1) FILTER (WHERE f = decision_time) - avg(ret_eq_1) FILTER (WHERE f <> decision_time), 9) AS excess FROM (SELECT *, min(decision_time) OVER (PARTITION BY theme_id) AS f FROM trr) GROUP BY 1""", (PAST, I.MEMBERS, RETURNS))
def theme_birth_by_id(spark, sf):
    born = alpha.first_seen(_returns(spark, sf), ["layer_id"])
    return rounded(alpha.theme_birth(born, "ret_eq_1").withColumn("decision_time", day("decision_time")), "born_return", "old_return", "excess", digits=9)


# ---- communities, consensus, lifecycle, paths


def _graphs(spark, sf):
    return _mutual(spark, sf).withColumn("snapshot_time", F.lit("2024-01-01").cast("timestamp"))


@query()
def communities_detected(spark, sf):
    out = communities.detect(_graphs(spark, sf), ["snapshot_time", "layer_id"]).withColumn("snapshot_time", day("snapshot_time"))
    return rounded(out, "modularity")


def _units(spark, sf):
    """Communities of users a day: two layers that group them by events of the day and by id."""
    layers = (("signed_flow@30m", F.col("n_events") % 5), ("price_impact@30m", F.col("symbol") % 9))
    both = F.array(*(F.struct(F.lit(name).alias("layer_name"), of.cast("int").alias("community_id")) for name, of in layers))
    rows = I.bars(spark, sf).select(F.col("timestamp").alias("snapshot_time"), "symbol", F.inline(both))
    return rows.groupBy("snapshot_time", "layer_name", "community_id").agg(F.array_sort(F.collect_set("symbol")).alias("members")).withColumn("is_market_mode", F.lit(False))


UNITS = """
us AS (SELECT DISTINCT "timestamp" AS snapshot_time, 'signed_flow@30m' AS layer_name, n_events % 5 AS community_id, symbol FROM bars UNION ALL SELECT DISTINCT "timestamp", 'price_impact@30m', symbol % 9, symbol FROM bars)"""


@query(f"SELECT {DAY.format('a.snapshot_time')} AS snapshot_time, a.symbol AS a, b.symbol AS b, round(count(*) * 0.5, 6) AS score FROM us a JOIN us b ON a.snapshot_time = b.snapshot_time AND a.layer_name = b.layer_name AND a.community_id = b.community_id AND a.symbol < b.symbol GROUP BY 1, 2, 3 HAVING count(*) * 0.5 >= 0.8", (I.BARS, UNITS))
def consensus_pairs(spark, sf):
    weights = {"signed_flow": 0.5, "price_impact": 0.5}
    out = communities.pair_scores(_units(spark, sf), weights, least=0.8)
    return rounded(out.withColumn("snapshot_time", day("snapshot_time")).drop("layers"), "score")


def _themes(spark, sf):
    families = {"signed_flow": "trade_flow", "price_impact": "liquidity"}
    return communities.consensus_themes(_units(spark, sf), families, weights={"signed_flow": 0.5, "price_impact": 0.5}, least=0.8)


@query()
def consensus_themes(spark, sf):
    return _themes(spark, sf).withColumn("snapshot_time", day("snapshot_time"))


@query()
def theme_lifecycle(spark, sf):
    return communities.lifecycle(_themes(spark, sf).select("snapshot_time", "theme_instance_id", "members"), 1440).withColumn("snapshot_time", day("snapshot_time"))


@query()
def theme_latest(spark, sf):
    events = communities.lifecycle(_themes(spark, sf).select("snapshot_time", "theme_instance_id", "members"), 1440)
    return communities.latest_per_path(events).withColumn("snapshot_time", day("snapshot_time"))


@query()
def structural_forest(spark, sf):
    u = _units(spark, sf)
    roots = u.where("layer_name = 'price_impact@30m'").groupBy("snapshot_time", (F.col("community_id") % 2).alias("k")).agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("members"))
    themes = roots.select("snapshot_time", F.concat(F.lit("T"), F.col("k").cast("string")).alias("theme_instance_id"), "members")
    return forest.structural_forest(themes, u).withColumn("snapshot_time", day("snapshot_time"))


@query()
def tracked_paths(spark, sf):
    return paths.track_paths(_units(spark, sf), ["layer_name"], least=5)


@query()
def path_metrics(spark, sf):
    return paths.arm_metrics(paths.track_paths(_units(spark, sf), ["layer_name"], least=5), ["layer_name", "arm"])


def _arm_summary(spark, sf):
    units = _units(spark, sf).withColumn("date", F.date_format("snapshot_time", "yyyy-MM-dd"))
    return paths.arm_summary(paths.track_paths(units, ["date", "layer_name"], least=5))


@query()
def arm_summary(spark, sf):
    return rounded(_arm_summary(spark, sf), *paths.MEANS, "score")


@query()
def recommended_arms(spark, sf):
    return rounded(paths.recommended_arms(_arm_summary(spark, sf)), *paths.MEANS, "score")


@query()
def hysteresis_replay(spark, sf):
    out = hysteresis.replay(I.edges(spark, sf), hysteresis.Hysteresis(0.6, 0.6, 0.5, 1))
    return rounded(out.withColumn("decision_time", day("decision_time")), "weight")


# ---- semantics

TL = "tm AS (SELECT 't' || c_custkey % 20 AS theme_id, c_custkey AS member_id FROM customer)"


def _theme_members(spark, sf):
    return I.table(spark, sf, "customer").select(F.concat(F.lit("t"), (F.col("c_custkey") % 20).cast("string")).alias("theme_id"), F.col("c_custkey").alias("member_id"))


def _theme_lists(spark, sf):
    return _theme_members(spark, sf).groupBy("theme_id").agg(F.array_sort(F.collect_list("member_id")).alias("members"))


#: Commonest values, ties by the first member.
TOPS = """
tops AS (SELECT theme_id, sector AS value, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY theme_id) AS share, row_number() OVER (PARTITION BY theme_id ORDER BY count(*) DESC, min(member_id)) AS r FROM tm JOIN metadata ON symbol_id = member_id WHERE sector IS NOT NULL GROUP BY 1, 2),
topi AS (SELECT theme_id, industry AS value, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY theme_id) AS share, row_number() OVER (PARTITION BY theme_id ORDER BY count(*) DESC, min(member_id)) AS r FROM tm JOIN metadata ON symbol_id = member_id WHERE industry IS NOT NULL GROUP BY 1, 2),
capped AS (SELECT theme_id, count(*) AS known, CASE WHEN median(market_cap) >= 200e9 THEN 'Mega-Cap' WHEN median(market_cap) >= 10e9 THEN 'Large-Cap' WHEN median(market_cap) >= 2e9 THEN 'Mid-Cap' WHEN median(market_cap) >= 300e6 THEN 'Small-Cap' ELSE 'Micro-Cap' END AS bucket,
  list(symbol::VARCHAR ORDER BY member_id) AS symbols, list(company ORDER BY member_id) AS companies FROM tm JOIN metadata ON symbol_id = member_id GROUP BY 1)"""


@query("""SELECT theme_id AS theme_instance_id, s.value || '/' || i.value || ' (' || bucket || '): ' || array_to_string(symbols[1:3], ', ') AS label_short, s.value AS sector_summary, i.value AS industry_summary, array_to_string(list_sort(list_distinct(['flow', 'price', s.value, i.value])), ',') AS tags, array_to_string(companies[1:5], ',') AS top_companies, array_to_string(symbols[1:5], ',') AS top_symbols, bucket AS market_cap_bucket, round(s.n / known, 6) AS semantic_coherence_score
  FROM capped JOIN (SELECT * FROM tops WHERE r = 1) s USING (theme_id) JOIN (SELECT * FROM topi WHERE r = 1) i USING (theme_id)""", (I.METADATA, TL, TOPS))
def semantic_labels(spark, sf):
    themes = _theme_lists(spark, sf).select(F.col("theme_id").alias("theme_instance_id"), "members", F.array(F.lit("price"), F.lit("flow")).alias("source_families"), F.lit(False).alias("is_market_mode"))
    out = semantics.labels(themes, I.metadata(spark, sf)).drop("label_long", "sector_distribution", "industry_distribution")
    return rounded(out.withColumns({c: F.array_join(c, ",") for c in ("tags", "top_companies", "top_symbols")}), "semantic_coherence_score")


@query("""SELECT theme_id, 1.0::DOUBLE AS metadata_coverage, array_to_string(symbols[1:15], ',') AS top_symbols, array_to_string(companies[1:8], ' | ') AS top_companies, bucket AS market_cap_bucket, s.value AS top_sector, round(s.share, 6) AS top_sector_share, i.value AS top_industry, round(i.share, 6) AS top_industry_share
  FROM capped JOIN (SELECT * FROM tops WHERE r = 1) s USING (theme_id) JOIN (SELECT * FROM topi WHERE r = 1) i USING (theme_id)""", (I.METADATA, TL, TOPS))
def member_summary(spark, sf):
    return rounded(semantics.member_summary(_theme_lists(spark, sf), I.metadata(spark, sf)), "metadata_coverage", "top_sector_share", "top_industry_share")


@query("""SELECT theme_id, round(0.35 * 0.5 + 0.25 * 0.6 + 0.2 * 0.7 + 0.1 * 0.8 + 0.1 * least(1, avg(abs(c_acctbal / 10000))), 9) AS theme_quality_score, round(least(1, avg(abs(c_acctbal / 10000))), 9) AS flow_support FROM tm JOIN customer ON c_custkey = member_id GROUP BY 1""", (TL,))
def theme_quality(spark, sf):
    t = _theme_lists(spark, sf).withColumns({"structure_score": F.lit(0.5), "consensus_score": F.lit(0.6), "stability_score": F.lit(0.7), "semantic_score": F.lit(0.8)})
    flow = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("member_id"), (F.col("c_acctbal") / 10000).alias("neighbor_signed_flow"))
    return rounded(semantics.theme_quality(t, flow).select("theme_id", "theme_quality_score", "flow_support"), "theme_quality_score", "flow_support", digits=9)


@query(f"""SELECT {DAY.format('decision_time')} AS snapshot_time, kind AS community_type, count(*) AS community_count, min(n) AS community_size_min, quantile_cont(n, 0.25) AS community_size_p25, quantile_cont(n, 0.5) AS community_size_median, quantile_cont(n, 0.75) AS community_size_p75, round(quantile_cont(n, 0.95), 6) AS community_size_p95, max(n) AS community_size_max, round(avg((n = 3)::INTEGER), 6) AS pct_eq_3_members, round(avg((n <= 5)::INTEGER), 6) AS pct_le_5_members, round(avg((n <= 10)::INTEGER), 6) AS pct_le_10_members
  FROM (SELECT decision_time, CASE WHEN substr(theme_id, 2)::INTEGER < 4 THEN 'child' ELSE 'parent' END AS kind, theme_id, count(*) AS n FROM members GROUP BY 1, 2, 3) GROUP BY 1, 2""", (I.BARS, I.MEMBERS))
def size_distribution(spark, sf):
    c = I.members(spark, sf).groupBy(F.col("decision_time").alias("snapshot_time"), "theme_id").agg(F.collect_list("member_id").alias("members")).withColumn("parent_id", F.when(F.substring("theme_id", 2, 9).cast("int") < 4, 9))
    return rounded(semantics.size_distribution(c, ["snapshot_time"]).withColumn("snapshot_time", day("snapshot_time")), "community_size_p95", "pct_eq_3_members", "pct_le_5_members", "pct_le_10_members")


@query("""SELECT theme_id, member_count, evidence_layers, round(greatest(s, i), 6) AS semantic_concentration_diagnostic, round(least(1, member_count / 40.0) * 0.3 + least(6, evidence_layers) / 6.0 * 0.35 + c * 0.15 + greatest(s, i) * 0.2, 6) AS forest_quality_score
  FROM (SELECT 't' || p_partkey AS theme_id, p_size AS member_count, p_partkey % 9 AS evidence_layers, (p_partkey % 10) / 10 AS c, (p_partkey % 7) / 7 AS s, (p_partkey % 5) / 5 AS i FROM part)
  ORDER BY least(1, member_count / 40.0) * 0.3 + least(6, evidence_layers) / 6.0 * 0.35 + c * 0.15 + greatest(s, i) * 0.2 DESC, evidence_layers DESC, member_count DESC, theme_id LIMIT 100""")
def forest_quality(spark, sf):
    k = F.col("p_partkey")
    leaves = I.table(spark, sf, "part").select(F.concat(F.lit("t"), k.cast("string")).alias("theme_id"), F.col("p_size").alias("member_count"), (k % 9).alias("evidence_layers"), ((k % 10) / 10).alias("metadata_coverage"), ((k % 7) / 7).alias("top_sector_share"), ((k % 5) / 5).alias("top_industry_share"))
    out = semantics.forest_quality(leaves, 100).select("theme_id", "member_count", "evidence_layers", "semantic_concentration_diagnostic", "forest_quality_score")
    return rounded(out, "semantic_concentration_diagnostic", "forest_quality_score")


# ---- QA, stores and serving


@query(f"""SELECT {DAY.format('decision_time')} AS decision_time, layer_id, count(*) AS edges, count(*) - count(DISTINCT (least(src_id, dst_id), greatest(src_id, dst_id))) AS duplicate_pairs, count(*) FILTER (WHERE src_id = dst_id) AS self_loops, count(*) FILTER (WHERE weight IS NULL OR NOT isfinite(weight)) AS non_finite, any_value(v) AS cap_violations
  FROM edges JOIN (SELECT decision_time, layer_id, count(*) FILTER (WHERE n > 30) AS v FROM (SELECT decision_time, layer_id, node, count(*) AS n FROM (SELECT decision_time, layer_id, src_id AS node FROM edges UNION ALL SELECT decision_time, layer_id, dst_id FROM edges) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (decision_time, layer_id) GROUP BY 1, 2""", (I.EDGES,))
def edge_violations(spark, sf):
    return qa.edge_violations(I.edges(spark, sf), ["decision_time", "layer_id"], 30).withColumn("decision_time", day("decision_time"))


@query("SELECT key, side FROM (SELECT DISTINCT user_id AS key, 'left' AS side FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events))")
def key_differences(spark, sf):
    a, b = I.table(spark, sf, "events").select(F.col("user_id").alias("key")), I.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    return qa.key_differences(a, b, ["key"])


UNIVERSE = """p AS (SELECT DISTINCT "timestamp"::DATE::VARCHAR AS d, symbol::VARCHAR AS symbol FROM bars), e AS (SELECT DISTINCT c_custkey::VARCHAR AS symbol FROM customer), ds AS (SELECT DISTINCT d FROM p),
  n AS (SELECT count(*) AS n FROM e), j AS (SELECT ds.d, e.symbol AS expected, p.symbol AS present FROM ds CROSS JOIN e LEFT JOIN p ON p.d = ds.d AND p.symbol = e.symbol UNION ALL SELECT p.d, NULL, p.symbol FROM p WHERE p.symbol NOT IN (SELECT symbol FROM e))"""


@query("""SELECT d AS trade_date, any_value(n) AS expected_symbols, count(present) FILTER (WHERE expected IS NOT NULL) AS present_expected_symbols, count(*) FILTER (WHERE present IS NULL) AS missing_count, count(*) FILTER (WHERE expected IS NULL) AS unexpected_count,
  array_to_string(coalesce((list(expected ORDER BY expected) FILTER (WHERE present IS NULL))[1:20], []), ',') AS missing_examples, array_to_string(coalesce((list(present ORDER BY present) FILTER (WHERE expected IS NULL))[1:20], []), ',') AS unexpected_examples, count(*) FILTER (WHERE present IS NULL) = 0 AS safe_for_full_rebuild FROM j, n GROUP BY 1""", (I.BARS, UNIVERSE))
def universe_stability(spark, sf):
    rows = I.bars(spark, sf).select(F.to_date("timestamp").cast("string").alias("trade_date"), "symbol")
    return qa.universe_stability(rows, I.table(spark, sf, "customer").select(F.col("c_custkey").alias("symbol")))


@query("""SELECT trade_date, s.symbol, count(b."close") AS available_points, round(1 - count(b."close") / any_value(t), 6) AS missing_ratio, count(b."close") < 5 AS fallback FROM (SELECT strftime("timestamp", '%Y-W%W') AS trade_date, count(DISTINCT "timestamp") AS t FROM bars GROUP BY 1) d CROSS JOIN (SELECT unnest([1, 2, 9999])::BIGINT AS symbol) s LEFT JOIN bars b ON b.symbol = s.symbol AND strftime(b."timestamp", '%Y-W%W') = d.trade_date GROUP BY 1, 2""", (I.BARS,))
def benchmark_coverage(spark, sf):
    week = F.concat(F.lit("2024-W"), F.lpad(F.floor((F.dayofyear("timestamp") + 6) / 7).cast("string"), 2, "0"))
    return rounded(qa.benchmark_coverage(I.bars(spark, sf).withColumn("trade_date", week), [1, 2, 9999], 5), "missing_ratio")


@query("SELECT year(decision_time) AS y, layer_id, count(*) AS row_count FROM edges GROUP BY 1, 2", (I.EDGES,))
def inventory(spark, sf):
    return qa.inventory(I.edges(spark, sf).withColumn("y", F.year("decision_time").cast("long")), ["y", "layer_id"])


@query()
def artifact_manifest(spark, sf):
    out = qa.artifact_manifest(spark, f"{sf}/events.parquet", "ts")
    return out.withColumns({"min_time": day("min_time"), "max_time": day("max_time")})


PATCH = "patch AS (SELECT decision_time, (CASE layer_id WHEN 1 THEN 1 ELSE 14 END)::INTEGER AS layer_id, lookback_minutes, src_id, dst_id, weight / 2 AS weight FROM edges WHERE layer_id IN (1, 2))"


def _patched(spark, sf):
    e = I.edges(spark, sf)
    patch = e.where("layer_id in (1, 2)").withColumns({"layer_id": F.when(F.col("layer_id") == 1, 1).otherwise(14), "weight": F.col("weight") / 2})
    return replaced_layers(e, patch, [1, 14, 15], [*G, "src_id", "dst_id"])


@query("SELECT layer_id, count(*) AS n, round(sum(weight), 4) AS weight FROM (SELECT * FROM edges WHERE layer_id NOT IN (1, 14, 15) UNION ALL SELECT * FROM patch) GROUP BY 1", (I.EDGES, PATCH))
def patch_merge(spark, sf):
    return _patched(spark, sf)[0].groupBy("layer_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query("SELECT (SELECT count(*) FROM edges) AS baseline_rows, (SELECT count(*) FROM edges WHERE layer_id NOT IN (1, 14, 15)) AS preserved_rows, (SELECT count(*) FROM patch) AS patch_rows, (SELECT count(*) FROM edges WHERE layer_id NOT IN (1, 14, 15)) + (SELECT count(*) FROM patch) AS merged_rows, 0::BIGINT AS duplicates", (I.EDGES, PATCH))
def patch_statistics(spark, sf):
    return _patched(spark, sf)[1]


@query("SELECT src_id, dst_id, weight FROM edges WHERE decision_time = TIMESTAMP '1997-01-01' AND layer_id IN (1, 3)", (I.EDGES,))
def graph_snapshot(spark, sf):
    return features.snapshot(I.edges(spark, sf), "1997-01-01", [1, 3]).select("src_id", "dst_id", "weight")


@query(f"""SELECT {DAY.format('b."timestamp"')} AS datetime, b.symbol AS instrument, b."close" AS feature__close, b.n_events AS "feature__n_events", l.label_1 AS label__1, l.label_2 AS label__2, g.g AS feature__graph__flow__degree FROM bars b LEFT JOIN labels l ON l.symbol = b.symbol AND l.decision_time = b."timestamp"
  LEFT JOIN (SELECT "timestamp", symbol, n_events + 1 AS g FROM bars) g ON g.symbol = b.symbol AND g."timestamp" = b."timestamp" WHERE b."timestamp" >= TIMESTAMP '2024-01-05' AND b."timestamp" <= TIMESTAMP '2024-01-20'""", (I.LABELS,))
def wide_matrix(spark, sf):
    b = I.bars(spark, sf).withColumnRenamed("timestamp", "decision_time")
    nodes = b.select("decision_time", "symbol", F.lit(4).alias("layer_id"), F.lit(30).alias("lookback_minutes"), (F.col("n_events") + 1).alias("degree"))
    nodes = nodes.unionByName(nodes.withColumns({"lookback_minutes": F.lit(5), "degree": F.lit(0).cast("long")}))
    out = features.wide_matrix(b.select("decision_time", "symbol", "close", "n_events"), I.labels(spark, sf), features.graph_pivot(nodes, {4: "flow"}, ["degree"]), "2024-01-05", "2024-01-20")
    return out.withColumn("datetime", day("datetime"))


@query("""SELECT event_id, upper(trim(' ' || event_type || ' ')) AS token, regexp_extract('flow@' || user_id || 'm', '@([0-9]+)m$', 1) AS minutes, substr(sha256(event_type || ',' || user_id), 1, 12) AS digest, json_extract_string(props, '$.k') AS k, least(user_id, event_id) AS low, greatest(user_id, event_id) AS high, TRY_CAST(event_type AS DOUBLE) AS number,
  round(sqrt(abs(value)) + ln(1 + abs(value)), 6) AS curve, regexp_replace(event_type || ':' || user_id || ' x=1.5-T', '[^a-zA-Z0-9=_.-]', '_', 'g') AS safe, ceil(value)::BIGINT AS up, floor(value)::BIGINT AS down FROM events""")
def scalar_functions(spark, sf):
    v = F.col("value")
    user = F.col("user_id").cast("string")
    return I.table(spark, sf, "events").select(
        "event_id", F.upper(F.trim(F.concat(F.lit(" "), "event_type", F.lit(" ")))).alias("token"), F.regexp_extract(F.concat(F.lit("flow@"), user, F.lit("m")), "@([0-9]+)m$", 1).alias("minutes"), F.substring(F.sha2(F.concat_ws(",", "event_type", user).cast("binary"), 256), 1, 12).alias("digest"),
        F.get_json_object("props", "$.k").alias("k"), F.least("user_id", "event_id").alias("low"), F.greatest("user_id", "event_id").alias("high"), F.expr("try_cast(event_type AS double)").alias("number"), F.round(F.sqrt(F.abs(v)) + F.log1p(F.abs(v)), 6).alias("curve"),
        safe_token(F.concat("event_type", F.lit(":"), user, F.lit(" x=1.5-T"))).alias("safe"), F.ceil(v).alias("up"), F.floor(v).alias("down"),
    )


@query("SELECT count(*) AS n, count(value) AS finite, round(avg(value), 6) AS mean FROM (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value FROM events)")
def nan_as_null(spark, sf):
    e = I.table(spark, sf, "events").select(F.when(F.col("event_id") % 10 == 0, float("nan")).otherwise(F.col("value")).alias("value"))
    return rounded(nan_to_null(e).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("finite"), F.avg("value").alias("mean")), "mean")
