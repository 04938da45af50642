"""Theme returns, spillover, core and peripheral signals, rank information and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THEME = ["decision_time", "layer_id", "scale", "level", "theme_id"]


def past_labels(labels: DataFrame, horizons: list[int], bar: int, unit: str = "minutes", legacy: bool = False) -> DataFrame:
    """labels with past_label_h for each horizon h: the label that began h + bar before, which enters a bar later and so ends by now.

    legacy: the label that began h before, which looks ahead by a bar; for comparisons alone.
    """
    out = labels
    for h in horizons:
        back = h if legacy else h + bar
        moved = labels.select("symbol", (F.col("decision_time") + F.expr(f"INTERVAL {back} {unit}")).alias("decision_time"), F.col(f"label_{h}").alias(f"past_label_{h}"))
        out = out.join(moved, ["decision_time", "symbol"], "left")
    return out


def theme_returns(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Returns of each theme for every label_h and past_label_h of labels, in one pass over members joined with labels.

    ret_eq_h (past_eq_h) is the mean, core the mean weighted by core_score, top5 and top10 the means of the members of
    greatest core_score, ties by member. Missing labels are skipped, but the weighted mean divides by the scores of all
    members, so one without a label counts as return 0.
    """
    names = [c for c in labels.columns if c.removeprefix("past_").removeprefix("label_").isdigit()]
    on = members.join(labels.select("decision_time", F.col("symbol").alias("member_id"), *names), ["decision_time", "member_id"])
    on = on.withColumn("_r", F.row_number().over(Window.partitionBy(*THEME).orderBy(F.desc("core_score"), "member_id")))
    weight = F.sum("core_score")
    out = []
    for c in names:
        kind, h = ("past" if c.startswith("past_") else "ret"), c.rsplit("_", 1)[1]
        core = F.when(weight != 0, F.coalesce(F.sum(F.col("core_score") * F.col(c)), F.lit(0.0)) / weight)
        tops = [F.avg(F.when(F.col("_r") <= k, F.col(c))).alias(f"{kind}_top{k}_{h}") for k in (5, 10)]
        out += [F.avg(c).alias(f"{kind}_eq_{h}"), core.alias(f"{kind}_core_{h}"), *tops]
    return on.groupBy(*THEME).agg(F.count(F.lit(1)).alias("member_count"), *out)


def spillover(relations: DataFrame, returns: DataFrame, past: str, targets: list[str]) -> DataFrame:
    """Signal of a target theme: mean of strength times the source's past return (null as 0), with mean strength, sources and target returns.

    returns: THEME columns, the past column and the targets, as theme_returns gives them.
    """
    key = THEME[:-1]
    src = returns.select(*key, F.col("theme_id").alias("src_theme_id"), F.col(past).alias("_p"))
    dst = returns.select(*key, F.col("theme_id").alias("dst_theme_id"), *(F.col(c).alias(c.replace("ret_eq_", "target_")) for c in targets))
    on = relations.join(src, [*key, "src_theme_id"]).join(dst, [*key, "dst_theme_id"])
    return on.groupBy(*key, "dst_theme_id").agg(
        F.avg(F.col("relation_strength") * F.coalesce("_p", F.lit(0.0))).alias("signal"), F.avg("relation_strength").alias("mean_strength"), F.count(F.lit(1)).alias("source_count"),
        *(F.first(c.replace("ret_eq_", "target_")).alias(c.replace("ret_eq_", "target_")) for c in targets),
    )


def core_peripheral(members: DataFrame, labels: DataFrame, label: str, least: int = 5) -> DataFrame:
    """Past mean of the core fifth, future mean of the peripheral half, and signal = core past * (top core score - peripheral score).

    Themes of `least` labelled members or more. Core: rank < max(1, n / 5); periphery: rank >= n - max(1, n / 2), ranks from 0 by falling core_score.
    """
    on = members.join(labels.select("decision_time", F.col("symbol").alias("member_id"), F.col(label).alias("x"), F.col(f"past_{label}").alias("p")), ["decision_time", "member_id"])
    w = Window.partitionBy(*THEME)
    on = on.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(F.desc("core_score"), "member_id")) - 1}).where(F.col("_n") >= least)
    core = F.col("_r") < F.greatest(F.lit(1), F.floor(F.col("_n") * 0.2))
    rim = F.col("_r") >= F.col("_n") - F.greatest(F.lit(1), F.floor(F.col("_n") * 0.5))
    out = on.groupBy(*THEME).agg(F.max("_n").alias("member_count"), F.avg(F.when(core, F.col("p"))).alias("core_past"), F.avg(F.when(rim, F.col("x"))).alias("peripheral_future"), F.max("core_score").alias("_c"), F.avg(F.when(rim, F.col("core_score"))).alias("_q"))
    return out.withColumn("signal", F.col("core_past") * (F.col("_c") - F.col("_q"))).drop("_c", "_q")


def rank_ic(rows: DataFrame, keys: list[str], signal: str, target: str, least: int = 20, distinct: int = 3) -> DataFrame:
    """Spearman correlation (average ranks), means at or above the 80 % and at or below the 20 % signal, spread and hit rate.

    Groups of fewer than `least` rows or `distinct` different signals are left out.
    """
    fit = rows.where(F.col(signal).isNotNull() & F.col(target).isNotNull()).repartition(*keys)  # one exchange for all windows, quantiles and sums
    w = Window.partitionBy(*keys)

    def average_rank(c: str):
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2

    ranked = fit.withColumns({"_a": average_rank(signal), "_b": average_rank(target)})
    q = fit.groupBy(*keys).agg(F.percentile(signal, F.array(F.lit(0.2), F.lit(0.8))).alias("_q"))
    s, t = F.col(signal), F.col(target)
    out = ranked.join(q, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(signal).alias("_d"), F.corr("_a", "_b").alias("rank_ic"), F.avg(F.when(s >= F.col("_q")[1], t)).alias("top_mean"), F.avg(F.when(s <= F.col("_q")[0], t)).alias("bottom_mean"),
        F.avg((s * t > 0).cast("double")).alias("hit_rate"),
    )
    return out.where((F.col("n") >= least) & (F.col("_d") >= distinct)).drop("_d").withColumn("spread", F.col("top_mean") - F.col("bottom_mean"))


def alpha_summary(metrics: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Weighted means by n (nulls as 0), share of dates with a positive IC, and the t-statistic of daily ICs (two dates or more)."""
    mean = lambda c: F.try_divide(F.sum(F.coalesce(c, F.lit(0.0)) * F.col("n")), F.sum("n"))
    by_date = metrics.groupBy(*keys, date).agg(mean("rank_ic").alias("_ic"))
    t = by_date.groupBy(*keys).agg(F.avg((F.col("_ic") > 0).cast("double")).alias("positive_date_ratio"), F.when(F.count(F.lit(1)) >= 2, F.try_divide(F.avg("_ic"), F.stddev_samp("_ic") / F.sqrt(F.count(F.lit(1))))).alias("t_stat"))
    return metrics.groupBy(*keys).agg(F.sum("n").alias("n"), mean("rank_ic").alias("rank_ic"), mean("spread").alias("spread")).join(t, keys)


def births(themes: DataFrame, continuation: DataFrame, key: list[str]) -> DataFrame:
    """themes (key, decision_time, theme_id, ...) with born: no theme of the frame before goes on in it, not even fuzzily.

    continuation: (key, dst_time, dst_theme_id), as forest.continuation gives it.
    """
    after = continuation.select(*key, F.col("dst_time").alias("decision_time"), F.col("dst_theme_id").alias("theme_id")).distinct()
    match = [*key, "decision_time", "theme_id"]
    return themes.join(after, match, "left_anti").withColumn("born", F.lit(True)).unionByName(themes.join(after, match, "left_semi").withColumn("born", F.lit(False)))


def first_seen(themes: DataFrame, key: list[str], date: str = "decision_time") -> DataFrame:
    """themes with born by the letter: a theme id that no earlier date has."""
    first = themes.groupBy(*key, "theme_id").agg(F.min(date).alias("_first"))
    return themes.join(first, [*key, "theme_id"]).withColumn("born", F.col(date) == F.col("_first")).drop("_first")


def theme_birth(returns: DataFrame, value: str, date: str = "decision_time") -> DataFrame:
    """Mean return of born themes less that of the others, by date. returns: (date, born, value)."""
    mean = lambda c: F.avg(F.when(c, F.col(value)))
    out = returns.groupBy(date).agg(F.sum(F.col("born").cast("long")).alias("born"), mean(F.col("born")).alias("born_return"), mean(~F.col("born")).alias("old_return"))
    return out.withColumn("excess", F.col("born_return") - F.col("old_return"))
