"""Point-in-time relational operators: sessions, decision grids, as-of panels, forward and split-adjusted labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_filter(events: DataFrame, timezone: str, opens: str, closes: str, ts: str = "timestamp", closed: bool = False) -> DataFrame:
    """Rows whose local time is opens or later and before closes (HH:mm; closed: or exactly closes), with session_date (local date)."""
    local = F.from_utc_timestamp(F.col(ts), timezone)
    clock = F.date_format(local, "HH:mm:ss.SSSSSS")
    until = clock <= f"{closes}:00.000000" if closed else clock < closes
    return events.where((clock >= opens) & until).withColumn("session_date", F.to_date(local))


def source_audit(events: DataFrame) -> DataFrame:
    """One row: rows, rows available before they happened, and duplicate (symbol, timestamp) keys."""
    keys = events.groupBy("symbol", "timestamp").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("available_time") < F.col("timestamp")).cast("long")).alias("early"))
    return keys.agg(F.sum("n").alias("row_count"), F.sum("early").alias("early_rows"), F.sum(F.col("n") - 1).alias("duplicate_rows"))


def decision_grid(events: DataFrame, step: str, close: Column | None = None) -> DataFrame:
    """decision_time from the first availability (rounded up) to the last (rounded down), no later than close, every step.

    step: an INTERVAL literal's text in whole units of one day or less, such as "1 day" or "5 minutes".
    """
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    n, unit = step.split()
    width = int(n) * seconds[unit.rstrip("s")]
    bounds = events.agg(F.min("available_time").alias("a"), F.max("available_time").alias("b"))
    begin = F.timestamp_seconds(F.ceil(F.unix_micros("a") / (width * 10**6)) * width)
    end = F.timestamp_seconds(F.floor(F.unix_micros("b") / (width * 10**6)) * width)
    end = F.least(end, close) if close is not None else end
    return bounds.select(begin.alias("a"), end.alias("b")).where("a <= b").select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias("decision_time"))


def pit_panel(events: DataFrame, grid: DataFrame, symbols: DataFrame, tolerance: str, values: list[str]) -> DataFrame:
    """The last row available at each (decision_time, symbol), no older than tolerance by availability.

    As-of join as one union and one window a symbol: grid rows sort after events of the same time, so a decision sees
    what became available at its very moment. Equal availabilities go to the later timestamp. Rows without a first value
    are dropped. The grid is small (times of a day by symbols) and its product with the symbols is the panel's size.
    """
    seen = F.struct(F.col("available_time"), F.col("timestamp"), *values)
    left = events.select("symbol", F.col("available_time").alias("t"), F.lit(0).alias("side"), F.col("timestamp").alias("o"), seen.alias("seen"))
    right = grid.crossJoin(symbols).select("symbol", F.col("decision_time").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("timestamp").alias("o"), F.lit(None).cast(left.schema["seen"].dataType).alias("seen"))
    w = Window.partitionBy("symbol").orderBy("t", "side", "o").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("seen", F.last("seen", ignorenulls=True).over(w)).where("side = 1")
    fresh = both.where(F.col("seen.available_time") >= F.col("t") - F.expr(f"INTERVAL {tolerance}"))
    return fresh.select(F.col("t").alias("decision_time"), "symbol", "seen.*").where(F.col(values[0]).isNotNull())


def panel_audit(panel: DataFrame) -> DataFrame:
    """One row: panel rows, rows seen before they were available, duplicate keys."""
    keys = panel.groupBy("decision_time", "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("available_time") > F.col("decision_time")).cast("long")).alias("ahead"))
    return keys.agg(F.sum("n").alias("row_count"), F.sum("ahead").alias("look_ahead_rows"), F.sum(F.col("n") - 1).alias("duplicate_rows"))


def forward_labels(panel: DataFrame, horizons: list[int], bar: int, unit: str = "minutes", price: str = "close") -> DataFrame:
    """Entry at the next bar, exit a horizon later: label_h = exit / entry - 1, null where a price is missing.

    Prices are found by equi-joins at shifted times.
    """
    prices = panel.select("symbol", F.col("decision_time").alias("at"), F.col(price).alias("p"))
    out = panel.select("decision_time", "symbol").withColumn("label_entry_time", F.col("decision_time") + F.expr(f"INTERVAL {bar} {unit}"))

    def priced(df: DataFrame, time: str, name: str) -> DataFrame:
        return df.join(prices.select("symbol", F.col("at").alias(time), F.col("p").alias(name)), ["symbol", time], "left")

    out = priced(out, "label_entry_time", "label_entry_price")
    for h in horizons:
        out = out.withColumn(f"label_exit_time_{h}", F.col("label_entry_time") + F.expr(f"INTERVAL {h} {unit}"))
        out = priced(out, f"label_exit_time_{h}", f"label_exit_price_{h}")
        out = out.withColumn(f"label_{h}", F.try_divide(f"label_exit_price_{h}", "label_entry_price") - 1)
    return out


def normalized_splits(splits: DataFrame) -> DataFrame:
    """(symbol, effective_date, share_multiplier, component_count): equal (symbol, date, ratio) rows once, ratios of a day multiplied."""
    clean = splits.select(F.upper(F.trim(F.col("symbol").cast("string"))).alias("symbol"), F.col("effective_date"), F.round("ratio", 12).alias("ratio")).where("ratio > 0").dropDuplicates()
    return clean.groupBy("symbol", "effective_date").agg(F.product("ratio").alias("share_multiplier"), F.count(F.lit(1)).alias("component_count"))


def cumulative_multiplier(spans: DataFrame, splits: DataFrame) -> DataFrame:
    """spans (symbol, entry_date, exit_date, ...) with multiplier: the product of splits with entry < effective <= exit, else 1."""
    keyed = spans.withColumn("_row", F.monotonically_increasing_id())
    hit = keyed.select("_row", "symbol", "entry_date", "exit_date").join(splits, "symbol").where("effective_date > entry_date and effective_date <= exit_date")
    found = hit.groupBy("_row").agg(F.product("share_multiplier").alias("multiplier"))
    return keyed.join(found, "_row", "left").drop("_row").withColumn("multiplier", F.coalesce("multiplier", F.lit(1.0)))


def split_adjusted_labels(labels: DataFrame, splits: DataFrame, horizon: int) -> DataFrame:
    """Raw and split-adjusted label of one horizon: adjusted = exit * multiplier / entry - 1.

    A label row finds its splits by symbol and date range; the joins are keyed by symbol and aggregated on the label's own key.
    """
    key = ["decision_time", "symbol"]
    spans = labels.select(*key, F.upper(F.trim(F.col("symbol").cast("string"))).alias("_symbol"), F.to_date("label_entry_time").alias("entry_date"), F.to_date(f"label_exit_time_{horizon}").alias("exit_date"))
    named = splits.withColumnRenamed("symbol", "_symbol")
    hit = spans.join(named, "_symbol").where("effective_date > entry_date and effective_date <= exit_date").groupBy(*key).agg(F.product("share_multiplier").alias("m"))
    out = labels.join(hit, key, "left").withColumn("label_split_multiplier", F.coalesce("m", F.lit(1.0))).drop("m")
    adjusted = F.try_divide(F.col(f"label_exit_price_{horizon}") * F.col("label_split_multiplier"), F.col("label_entry_price")) - 1
    return out.select(*key, "label_entry_price", F.col(f"label_exit_price_{horizon}").alias("label_exit_price_raw"), "label_split_multiplier", F.col(f"label_{horizon}").alias("label_raw"), adjusted.alias("label_split_adj"))


def universe(events: DataFrame, least_times: int, most: int) -> DataFrame:
    """The symbols with least_times distinct timestamps or more, the `most` with the most rows (ties by symbol)."""
    sizes = events.groupBy("symbol").agg(F.countDistinct("timestamp").alias("times"), F.count(F.lit(1)).alias("n"))
    return sizes.where(F.col("times") >= least_times).orderBy(F.desc("n"), "symbol").limit(most)


def visible_windows(events: DataFrame, lookbacks: list[int], unit_seconds: int, decisions: DataFrame) -> DataFrame:
    """Each event with every (decision_time, lookback) that sees it: available by then, within (t - lookback, t].

    The overlapping windows become an equi-join: an event is exploded to the at most max(lookbacks) grid times that
    could see it, which must be whole multiples of the unit.
    """
    most = max(lookbacks)
    first = F.ceil(F.unix_seconds("timestamp") / unit_seconds)
    times = F.explode(F.sequence(first, first + most - 1))
    out = events.withColumn("decision_time", times).withColumn("decision_time", F.timestamp_seconds(F.col("decision_time") * unit_seconds)).join(decisions, "decision_time", "left_semi")
    out = out.where(F.col("available_time") <= F.col("decision_time")).withColumn("lookback", F.explode(F.array(*map(F.lit, lookbacks))))
    return out.where((F.unix_seconds("decision_time") - F.unix_seconds("timestamp")) < F.col("lookback") * unit_seconds)


def due(times: DataFrame, opens: Column, step: int) -> DataFrame:
    """Decision times that lie a whole number of `step` minutes after opens."""
    return times.where(F.pmod((F.unix_seconds("decision_time") - F.unix_seconds(opens)) / 60, F.lit(step)) == 0)


def every_kth(rows: DataFrame, k: int, order: str = "decision_time") -> DataFrame:
    """Rows of every k-th distinct value of `order`, the first included. The distinct values, not the rows, are ranked."""
    ranked = rows.select(order).distinct().withColumn("_r", F.row_number().over(Window.orderBy(order)) - 1)
    return rows.join(ranked.where(F.col("_r") % k == 0).select(order), order, "left_semi")


def pit_qa(events: DataFrame, decisions: DataFrame, lookback: int, unit_seconds: int) -> DataFrame:
    """Per decision: rows within (t - lookback units, t] by time, visible ones, those not yet available, and symbols seen.

    As in visible_windows, an event is exploded to the grid times that could see it, whole multiples of the unit, and meets the decisions in an equi-join.
    """
    first = F.ceil(F.unix_seconds("timestamp") / unit_seconds)
    at = events.select("symbol", "timestamp", "available_time", F.explode(F.sequence(first, first + lookback - 1)).alias("k")).withColumn("decision_time", F.timestamp_seconds(F.col("k") * unit_seconds))
    at = at.where(F.unix_seconds("decision_time") - F.unix_seconds("timestamp") < lookback * unit_seconds)
    visible = F.col("available_time") <= F.col("decision_time")
    near = decisions.select("decision_time").distinct().join(at, "decision_time", "left")
    return near.groupBy("decision_time").agg(
        F.count("symbol").alias("eligible"), F.coalesce(F.sum(visible.cast("long")), F.lit(0)).alias("visible"), F.coalesce(F.sum((~visible).cast("long")), F.lit(0)).alias("filtered"), F.countDistinct(F.when(visible, F.col("symbol"))).alias("symbols")
    )


def prefix_difference(build, events: DataFrame, time) -> DataFrame:
    """Rows that differ between what build(events) gives at one decision time and what build gives from the events available by then; empty if nothing looks ahead.

    build: events to a table with decision_time.
    """
    at = F.col("decision_time") == F.lit(time)
    whole, prefix = build(events).where(at), build(events.where(F.col("available_time") <= F.lit(time))).where(at)
    return whole.exceptAll(prefix).withColumn("side", F.lit("whole")).unionByName(prefix.exceptAll(whole).withColumn("side", F.lit("prefix")))


def cadence(times: DataFrame, order: str = "decision_time") -> DataFrame:
    """One row: the median positive gap of distinct times in whole minutes, at least 1."""
    gap = (F.unix_seconds(order) - F.unix_seconds(F.lag(order).over(Window.orderBy(order)))) / 60
    return times.select(order).distinct().select(gap.alias("g")).where("g > 0").agg(F.greatest(F.lit(1), F.round(F.median("g")).cast("long")).alias("frame_minutes"))
