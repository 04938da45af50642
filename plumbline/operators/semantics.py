"""Semantic labels, member summaries and quality of themes from a metadata dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lower bounds of market-cap buckets.
CAP_BUCKETS = ((200e9, "Mega-Cap"), (10e9, "Large-Cap"), (2e9, "Mid-Cap"), (300e6, "Small-Cap"))


def cap_bucket(value: Column) -> Column:
    out = F.when(value.isNull(), "Unknown")
    for low, name in CAP_BUCKETS:
        out = out.when(value >= low, name)
    return out.otherwise("Micro-Cap")


def top_shares(rows: DataFrame, key: list[str], column: str, top: int) -> DataFrame:
    """(key, value, n, share, r): the `top` commonest non-null values; of equally common ones the first by place. Shares are of non-null rows."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*key, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    w = Window.partitionBy(*key)
    return counts.withColumns({"share": F.col("n") / F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), "first"))}).where(F.col("r") <= top)


def described(themes: DataFrame, metadata: DataFrame, key: list[str]) -> DataFrame:
    """(key, place, member_id, known) and the metadata's columns of every member; place: its number in the theme's list."""
    rows = themes.select(*key, F.posexplode("members").alias("place", "member_id"))
    return rows.join(metadata.withColumnRenamed("symbol_id", "member_id").withColumn("known", F.lit(True)), "member_id", "left")


def firsts(column: str, most: int) -> Column:
    """The first `most` non-null values by place, as text."""
    listed = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("place", F.col(column).cast("string").alias("v")))))
    return F.slice(F.transform(listed, lambda x: x["v"]), 1, most)


def shares_json(rows: DataFrame, key: list[str], column: str, top: int) -> DataFrame:
    """(key, top value, its n and share, JSON of the `top` commonest values' shares in order)."""
    best = top_shares(rows, key, column, top)
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("r", "value", "share"))), lambda x: F.struct(x["value"], F.round(x["share"], 6)))
    first = lambda c: F.max(F.when(F.col("r") == 1, F.col(c)))
    return best.groupBy(*key).agg(first("value").alias(f"top_{column}"), first("n").alias(f"_{column}_n"), first("share").alias(f"top_{column}_share"), F.to_json(F.map_from_entries(pairs)).alias(f"{column}_distribution"))


def labels(themes: DataFrame, metadata: DataFrame, key: list[str] = ["theme_instance_id"]) -> DataFrame:
    """Sector and industry summaries (Mixed if none), their five commonest shares, cap bucket, tags, titles, top five symbols and companies, coherence.

    Coherence is the main sector's members over all that metadata knows, or min(1, 0.4 + 0.1 * families) without a
    sector. themes: (key, members, source_families, is_market_mode).
    """
    on = described(themes, metadata, key)
    out = on.groupBy(*key).agg(F.count("known").alias("_known"), cap_bucket(F.median("market_cap")).alias("market_cap_bucket"), firsts("symbol", 5).alias("top_symbols"), firsts("company", 5).alias("top_companies"))
    for c in ("sector", "industry"):
        out = out.join(shares_json(on, key, c, 5), key, "left").fillna({f"top_{c}": "Mixed", f"{c}_distribution": "{}"})
    out = themes.select(*key, "members", "source_families", "is_market_mode").join(out, key, "left")
    sector, industry = F.col("top_sector"), F.col("top_industry")
    named = F.array(sector, industry, F.col("market_cap_bucket"))
    fallback = F.transform(F.slice("members", 1, 3), lambda m: m.cast("string"))
    title = F.when(F.size("top_symbols") > 0, F.slice("top_symbols", 1, 3)).otherwise(fallback)
    short = F.when(F.col("is_market_mode"), F.concat(F.lit("Market Mode: "), named[0], F.lit("/"), named[1], F.lit(" ("), named[2], F.lit(")")))
    short = short.otherwise(F.concat(named[0], F.lit("/"), named[1], F.lit(" ("), named[2], F.lit("): "), F.array_join(title, ", ")))
    tags = F.array_sort(F.array_distinct(F.array_union(F.col("source_families"), F.filter(F.array(sector, industry), lambda x: x != "Mixed"))))
    coherence = F.when(sector != "Mixed", F.col("_sector_n") / F.col("_known")).otherwise(F.least(F.lit(1.0), 0.4 + 0.1 * F.size("source_families")))
    return out.select(
        *key, short.alias("label_short"), short.alias("label_long"), sector.alias("sector_summary"), industry.alias("industry_summary"), tags.alias("tags"), "top_companies", "top_symbols", "sector_distribution", "industry_distribution", "market_cap_bucket", coherence.alias("semantic_coherence_score")
    )


def member_summary(themes: DataFrame, metadata: DataFrame, key: list[str] = ["theme_id"]) -> DataFrame:
    """Metadata coverage, the first 15 symbols and 8 companies, top sector and industry with their shares, cap bucket. Unknown and 0 where nothing is known. themes: (key, members)."""
    on = described(themes, metadata, key)
    out = on.groupBy(*key).agg(
        F.avg(F.col("symbol").isNotNull().cast("double")).alias("metadata_coverage"), F.array_join(firsts("symbol", 15), ",").alias("top_symbols"), F.array_join(firsts("company", 8), " | ").alias("top_companies"), cap_bucket(F.median("market_cap")).alias("market_cap_bucket")
    )
    for c in ("sector", "industry"):
        top = top_shares(on, key, c, 1).select(*key, F.col("value").alias(f"top_{c}"), F.col("share").alias(f"top_{c}_share"))
        out = out.join(top, key, "left").fillna({f"top_{c}": "Unknown", f"top_{c}_share": 0.0})
    return out


def theme_quality(themes: DataFrame, flow: DataFrame) -> DataFrame:
    """0.35 structure + 0.25 consensus + 0.20 stability + 0.10 semantic + 0.10 flow; flow = min(1, mean |neighbour flow| of members).

    themes: (theme_id, members, structure_score, consensus_score, stability_score, semantic_score); flow: (member_id, neighbor_signed_flow).
    """
    mean = themes.select("theme_id", F.explode("members").alias("member_id")).join(flow, "member_id").groupBy("theme_id").agg(F.least(F.lit(1.0), F.avg(F.abs("neighbor_signed_flow"))).alias("flow_support"))
    out = themes.join(mean, "theme_id", "left").fillna({"flow_support": 0.0})
    return out.withColumn("theme_quality_score", 0.35 * F.col("structure_score") + 0.25 * F.col("consensus_score") + 0.2 * F.col("stability_score") + 0.1 * F.col("semantic_score") + 0.1 * F.col("flow_support"))


def relabelled(themes: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored themes with semantics from another metadata dimension: (themes with new coherence, quality and breakdown, semantics).

    themes: (theme_instance_id, members, source_families, is_market_mode, structure_score, consensus_score,
    stability_score, flow_support_score, quality_breakdown as JSON); other columns stay.
    """
    semantics = labels(themes, metadata)
    fresh = themes.drop("semantic_coherence_score", "theme_quality_score").join(semantics.select("theme_instance_id", "semantic_coherence_score"), "theme_instance_id")
    score = 0.35 * F.col("structure_score") + 0.25 * F.col("consensus_score") + 0.2 * F.col("stability_score") + 0.1 * F.col("semantic_coherence_score") + 0.1 * F.coalesce("flow_support_score", F.lit(0.0))
    held = F.coalesce(F.from_json("quality_breakdown", "map<string,double>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    entries = F.array_append(F.filter(F.map_entries(held), lambda e: e["key"] != "semantic"), F.struct(F.lit("semantic").alias("key"), F.col("semantic_coherence_score").alias("value")))
    return fresh.withColumns({"theme_quality_score": score, "quality_breakdown": F.to_json(F.map_from_entries(F.array_sort(entries)))}), semantics


def size_distribution(communities: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of parent and of child communities of each key: count, least, quartiles, 95 %, largest, shares of size 3, of 5 and of 10 at most.

    communities: (keys, parent_id, members); parents have a null parent_id.
    """
    n = F.size("members")
    rows = communities.select(*keys, F.when(F.col("parent_id").isNull(), "parent").otherwise("child").alias("community_type"), n.alias("n"))
    q = F.percentile("n", F.array(*map(F.lit, [0.25, 0.5, 0.75, 0.95])))
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*keys, "community_type").agg(
        F.count(F.lit(1)).alias("community_count"), F.min("n").alias("community_size_min"), *(q[i].alias(f"community_size_{p}") for i, p in enumerate(("p25", "median", "p75", "p95"))), F.max("n").alias("community_size_max"),
        share(F.col("n") == 3).alias("pct_eq_3_members"), share(F.col("n") <= 5).alias("pct_le_5_members"), share(F.col("n") <= 10).alias("pct_le_10_members"),
    )


def forest_quality(leaves: DataFrame, most: int = 1000) -> DataFrame:
    """Leaves by falling quality, then evidence layers, then members, the best `most`.

    Quality: 0.30 * min(1, members / 40) + 0.35 * min(6, layers) / 6 + 0.15 * metadata coverage + 0.20 * the greater of
    sector and industry share. leaves: (theme_id, member_count, evidence_layers, metadata_coverage, top_sector_share, top_industry_share).
    """
    best = F.greatest("top_sector_share", "top_industry_share")
    size, layers = F.least(F.lit(1.0), F.col("member_count") / 40.0), F.least(F.lit(6), F.col("evidence_layers")) / 6.0
    scored = leaves.withColumns({"semantic_concentration_diagnostic": best, "forest_quality_score": 0.3 * size + 0.35 * layers + 0.15 * F.col("metadata_coverage") + 0.2 * best})
    return scored.orderBy(F.desc("forest_quality_score"), F.desc("evidence_layers"), F.desc("member_count"), "theme_id").limit(most)


def forest_summary(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: roots, split roots, leaves, and medians of the roots' and leaves' members. nodes: (keys, level 0 or 1, split_status, member_count)."""
    root, leaf = F.col("level") == 0, F.col("level") == 1
    many = lambda c: F.sum(c.cast("long"))
    return nodes.groupBy(*keys).agg(
        many(root).alias("root_nodes"), many(root & (F.col("split_status") == "split")).alias("split_roots"), many(leaf).alias("leaf_nodes"),
        F.coalesce(F.median(F.when(root, F.col("member_count"))), F.lit(0.0)).alias("median_root_members"), F.coalesce(F.median(F.when(leaf, F.col("member_count"))), F.lit(0.0)).alias("median_leaf_members"),
    )
