"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import documents, forget, fresh, ship, stored

#: Bits of MD5 that make a document's uniform number: 13 hexadecimal digits, exact in a double.
HEX_DIGITS = 13
#: Rates of more sources than this, and distribution functions of more values, are joined as Spark decides, not sent to every task.
BROADCAST_SOURCES, BROADCAST_STEPS = 10_000, 1_000_000


def uniform(seed: int, *parts) -> F.Column:
    """A number in [0, 1) from the MD5 of the seed and parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("long") / F.lit(float(16**HEX_DIGITS))


def poisson_steps(rate: float) -> list[float]:
    """The distribution function at 0, 1, 2, ... up to where a double cannot tell it from 1."""
    out, term, total, k = [], math.exp(-rate), 0.0, 0
    while k <= rate or term > 1e-17:
        total += term
        out.append(min(total, 1.0))
        k += 1
        term *= rate / k
    return out


def poisson_window(rate: float) -> tuple[int, list[float]]:
    """(first, the distribution function at first, first + 1, ...) over all that a double can tell from 0 and 1.

    Terms are taken relative to the mode's and divided by their sum, so no rate is too large for exp(-rate).
    """
    mode = int(rate)
    low, high = [], [1.0]
    term, k = 1.0, mode
    while k and term > 1e-20:
        term *= k / rate
        k -= 1
        low.append(term)
    term, first, k = 1.0, k, mode
    while term > 1e-20:
        k += 1
        term *= rate / k
        high.append(term)
    terms = low[::-1] + high
    whole = math.fsum(terms)
    return first, [min(x / whole, 1.0) for x in accumulate(terms)]


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, total: float, source: str) -> DataFrame:
    """(_source, _rate), stored: mean copies a document of each source: rate = target share * total rows wanted / rows of the source.

    weights: the target shares; None: every source's share is rows^temperature. A source without a weight has rate 0.
    """
    rows, path = stored(docs.groupBy(F.col(source).cast("string").alias("_source")).agg(F.count(F.lit(1)).alias("_rows")), "source-rows")
    if weights is None:
        shares = rows.withColumn("_share", F.sqrt("_rows") if temperature == 0.5 else F.pow("_rows", F.lit(float(temperature))))
    else:
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "_source string, _share double")
        shares = rows.join(given, "_source", "left").fillna({"_share": 0.0})
    n, whole = shares.agg(F.sum("_rows"), F.sum("_share")).first()
    rate = F.lit(total * (n or 0)) * F.col("_share") / F.lit(whole or 1.0) / F.col("_rows")
    out = stored(shares.select("_source", rate.alias("_rate")), "source-rates")[0]
    forget(docs.sparkSession, path)
    return out


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: float = 1.0, seed: int = 17, source: str = "source", key: str = "doc_id", max_sources: int | None = None, max_rate: float = 500.0) -> DataFrame:
    """Every column of docs, with copy (from 0) and place (a random sort key): each row comes Poisson(rate) times.

    A row's count inverts the Poisson distribution of its source's mean rate at a number hashed from seed and doc_id,
    so a rerun gives the same copies and a row's count depends on no other row but through its source's rate. Copies
    are then dealt to tasks by a second hash and sorted by it within, which is one random order of all copies. Nulls
    are a source of their own; rows that repeat a doc_id have equal counts. total: rows wanted over rows given.
    Rates are a table, and so are the distribution functions of distinct rates, which tasks compute; a rate above
    max_rate has its function computed from the mode. Both are broadcast while they are few, else joined as Spark decides.
    More than max_sources sources, if given, are refused with ValueError. Columns copy and place are replaced. Empty
    tables give empty results.
    """
    rates = repetition_rates(docs, weights, temperature, total, source)
    sources = rates.count()
    if max_sources is not None and sources > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    ship(docs.sparkSession)

    def functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = [(r, *((0, poisson_steps(r)) if r <= max_rate else poisson_window(r))) for r in p["_rate"]]
            yield pd.DataFrame(got, columns=["_rate", "_first", "_steps"])

    steps, _ = stored(rates.select("_rate").distinct().mapInPandas(functions, "_rate double, _first int, _steps array<double>"), "poisson-steps")
    few = sources <= BROADCAST_SOURCES and (steps.agg(F.sum(F.size("_steps"))).first()[0] or 0) <= BROADCAST_STEPS
    return replicate(docs, F.broadcast(rates) if few else rates, F.broadcast(steps) if few else steps, seed, source, key)


def replicate(docs: DataFrame, rates: DataFrame, steps: DataFrame, seed: int, source: str, key: str) -> DataFrame:
    """rates: (_source, _rate); steps: (_rate, _first, _steps)."""
    docs = docs.drop("copy", "place")
    name, rate, own, first, cdf, u, n = fresh(docs.columns, "_source", "_rate", "_own", "_first", "_steps", "_u", "_n")
    out = docs.join(rates.toDF(name, rate), F.col(source).cast("string").eqNullSafe(F.col(name)))
    out = out.join(steps.toDF(own, first, cdf), F.col(rate) == F.col(own)).withColumn(u, uniform(seed, F.col(key)))
    out = out.withColumn(n, F.col(first) + F.size(F.filter(cdf, lambda c: c <= F.col(u)))).where(F.col(n) > 0)
    out = out.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("copy"))
    out = out.withColumn("place", uniform(seed + 1, F.col(key), F.col("copy")))
    return out.repartition("place").sortWithinPartitions("place")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to shares that grow with the root of a source's rows; mix_sources states every case."""
    return mix_sources(documents(spark, sf_dir))


OP3_SQL = f"""
WITH RECURSIVE s AS (
  SELECT source, count(*) AS c, sum(count(*)) OVER () AS n, sqrt(count(*)) AS share, sum(sqrt(count(*))) OVER () AS whole FROM documents GROUP BY source
), r AS (SELECT source, n * share / whole / c AS rate FROM s),
p AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS cdf FROM r
  UNION ALL SELECT source, rate, k + 1, term * rate / (k + 1), cdf + term * rate / (k + 1) FROM p WHERE k + 1 <= rate OR term * rate / (k + 1) > 1e-17
), d AS (
  SELECT *, ('0x' || substr(md5('17|' || doc_id), 1, {HEX_DIGITS}))::BIGINT / {16**HEX_DIGITS}.0::DOUBLE AS u FROM documents
), q AS (
  SELECT d.doc_id, count(*) AS times FROM d JOIN p ON d.source = p.source WHERE p.cdf <= d.u GROUP BY d.doc_id
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy, ('0x' || substr(md5('18|' || d.doc_id || '|' || c.copy), 1, {HEX_DIGITS}))::BIGINT / {16**HEX_DIGITS}.0::DOUBLE AS place
FROM d JOIN q ON d.doc_id = q.doc_id, LATERAL (SELECT unnest(range(0, q.times))::INTEGER AS copy) c
"""
