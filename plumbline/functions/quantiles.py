"""Exact order statistics of large groups without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch that brackets a rank: its rank is off by n / ACCURACY at most.
ACCURACY = 10_000
#: Groups of fewer rows are taken whole.
SMALL = 4 * ACCURACY


def quantile_ranks(quantiles: list[float]) -> dict[str, Column]:
    """The two ranks (from 0) that linear interpolation of each quantile of `_n` values reads, named by number."""
    out = {}
    for i, q in enumerate(quantiles):
        at = F.col("_n") * F.lit(float(q)) - F.lit(float(q))
        out[f"lo{i}"], out[f"hi{i}"] = F.floor(at), F.ceil(at)
    return out


def order_statistics(rows: DataFrame, group: list[str], value: str, ranks: dict[str, Column], near: dict[str, float]) -> DataFrame:
    """(group, _n, one column a rank): the values at these ranks (from 0, rising; expressions of _n) of each group's values, without nulls and NaN.

    near: about which share of the values a rank lies. A mergeable sketch brackets each rank; the rows below a bracket
    are counted, and only the distinct values inside it, some ten-thousandths of a group, are ordered. Small groups are ordered whole.
    """
    names = list(ranks)
    fit = rows.select(*group, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("_v")).where("_v is not null")
    margin = 3.0 / ACCURACY
    cuts = sorted({min(max(near[n] + d, 0.0), 1.0) for n in names for d in (-margin, margin)})
    at = {c: i for i, c in enumerate(cuts)}
    stats = fit.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", cuts, ACCURACY).alias("_cuts"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    whole = F.col("_n") <= SMALL
    brackets = F.array(*(F.struct(
        F.lit(i).alias("i"), ranks[n].cast("long").alias("rank"),
        F.when(whole, F.col("_lo")).otherwise(F.col("_cuts")[at[min(max(near[n] - margin, 0.0), 1.0)]]).alias("low"),
        F.when(whole, F.col("_hi")).otherwise(F.col("_cuts")[at[min(max(near[n] + margin, 0.0), 1.0)]]).alias("high"),
    ) for i, n in enumerate(names)))
    on = fit.join(stats.select(*group, brackets.alias("_b")), group).select(*group, "_v", F.explode("_b").alias("b")).where(F.col("_v") <= F.col("b.high"))
    inside = F.when(F.col("_v") >= F.col("b.low"), F.col("_v"))
    counts = on.groupBy(*group, F.col("b.i").alias("i"), F.col("b.rank").alias("rank"), inside.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group, "i").orderBy(F.col("_v").asc_nulls_first())
    placed = counts.withColumn("_end", F.sum("_c").over(w)).where((F.col("_end") > F.col("rank")) & (F.col("_end") - F.col("_c") <= F.col("rank")))
    found = placed.groupBy(*group).agg(*(F.max(F.when(F.col("i") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)))
    return stats.select(*group, "_n").join(found, group)


def exact_quantiles(rows: DataFrame, group: list[str], value: str, quantiles: dict[str, float], ranks: dict[str, Column] | None = None, near: dict[str, float] | None = None) -> DataFrame:
    """(group, one column a quantile): exact quantiles with linear interpolation of each group's values, without nulls and NaN.

    ranks, near: more order statistics to find in the same pass, as order_statistics takes them; then _n stays too.
    """
    qs = list(quantiles.values())
    places = {f"{side}{i}": q for i, q in enumerate(qs) for side in ("lo", "hi")}
    got = order_statistics(rows, group, value, quantile_ranks(qs) | (ranks or {}), places | (near or {}))
    out = []
    for i, name in enumerate(quantiles):
        share = F.col("_n") * F.lit(float(qs[i])) - F.lit(float(qs[i]))
        low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
        out.append((low + (high - low) * (share - F.floor(share))).alias(name))
    return got.select(*group, *out, *(["_n", *ranks] if ranks else []))
