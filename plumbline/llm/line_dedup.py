"""Line-level dedup against levelled sorted runs of line hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import BLANKS, SortedRun, ascii_lower, documents, forget, fresh, sorted_scans, stored

RUN_SCHEMA = T.StructType([T.StructField("line_hash", T.BinaryType()), T.StructField("first_doc", T.LongType()), T.StructField("epoch", T.IntegerType())])
#: Bytes of text for a bucket of the runs, and bytes whose square root counts the batches.
BUCKET_BYTES, BATCH_BYTES = 64_000_000, 32_000_000
LEAST_BATCHES = 4


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, text: str, key: str, min_chars: int) -> DataFrame:
    """(doc_id, text_id, pos, line_hash) of every line whose key has min_chars code points or more.

    text_id tells rows that repeat a doc_id with another text apart. Rows with a null doc_id have no place in the
    order of documents, so they give no lines.
    """
    lines = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_id"), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    return lines.withColumn("k", line_key(F.col("line"))).where(F.length("k") >= min_chars).select("doc_id", "text_id", "pos", F.unhex(F.md5("k")).alias("line_hash"))


class LineRuns:
    """Sorted runs of line hashes in levels, each a table (line_hash, first_doc, epoch) bucketed and sorted by line_hash.

    A hash is in one run only. add() takes a batch: hashes that no run holds become a new run of level 0; when a level
    has `fan_in` runs, they are merged into one of the next level, so that a batch meets at most fan_in * log(batches)
    runs. All runs have `buckets` buckets, so that a batch's hashes, dealt once, meet every run in merge joins that
    neither exchange nor sort it. A caller may keep an object for later tables: each call of line_dedup is an epoch,
    and lines of earlier epochs are taken whatever their doc_id. drop() deletes the runs.
    """

    def __init__(self, spark: SparkSession, fan_in: int = 4, buckets: int = 8):
        self.spark, self.fan_in, self.buckets, self.epoch = spark, fan_in, buckets, 0
        self.levels: list[list[SortedRun]] = [[]]

    def runs(self) -> list[SortedRun]:
        return [run for level in self.levels for run in level]

    def all_runs(self) -> DataFrame:
        """The rows of all runs, read as plain files: a table that a join deals like any other."""
        paths = [run.path for run in self.runs()]
        return self.spark.read.schema(RUN_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], RUN_SCHEMA)

    def add(self, lines: DataFrame) -> None:
        """Add a batch's hashes that no run holds, with the smallest doc_id of each.

        The batch is aggregated and stored as a run of its own before it meets the others, so that a hot line is one
        row there and no join sees its copies.
        """
        own = lines.groupBy("line_hash").agg(F.min("doc_id").alias("first_doc"), F.lit(self.epoch).alias("epoch"))
        batch = SortedRun(own, "line_hash", self.buckets, "line-run", dealt=True)
        with sorted_scans(self.spark):
            held = self.runs()
            if held:
                new = batch.rows()
                for run in held:
                    new = new.join(run.rows().select("line_hash").hint("merge"), "line_hash", "left_anti")
                self.levels[0].append(SortedRun(new, "line_hash", self.buckets, "line-run"))
                batch.drop()
            else:
                self.levels[0].append(batch)
            self.compact()

    def compact(self) -> None:
        """Merge full levels two runs at a time. A hash is in one run only, so a full outer merge join of two is their merge."""
        for n, level in enumerate(self.levels):
            if len(level) < self.fan_in:
                return
            while len(level) > 1:
                one, two = level.pop(0), level.pop(0)
                both = one.rows().alias("a").join(two.rows().alias("b").hint("merge"), F.col("a.line_hash") == F.col("b.line_hash"), "full_outer")
                level.append(SortedRun(both.select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in RUN_SCHEMA.names)), "line_hash", self.buckets, "line-run"))
                one.drop()
                two.drop()
            if n + 1 == len(self.levels):
                self.levels.append([])
            self.levels[n + 1].append(level.pop())

    def drop(self) -> None:
        for run in self.runs():
            run.drop()
        self.levels = [[]]


def repeated_lines(lines: DataFrame, runs: DataFrame, epoch: int) -> DataFrame:
    """(doc_id, text_id, pos) of lines whose hash an earlier document or epoch holds.

    Both sides are dealt by plain exchanges, so that a hot line's rows can be split.
    """
    earlier = (F.col("epoch") < epoch) | (F.col("doc_id") > F.col("first_doc"))
    return lines.join(runs, "line_hash").where(earlier).select("doc_id", "text_id", "pos")


def without(lines: Column, drops: Column) -> Column:
    """The array of lines without the (sorted, 0-based) positions drops, cut in slices between them."""
    starts = F.concat(F.array(F.lit(0)), F.transform(drops, lambda p: p + 1))
    ends = F.concat(drops, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = 10, batches: int | None = None, fan_in: int = 4, runs: LineRuns | None = None) -> DataFrame:
    """Every column of docs, its text without repeated lines, and n_lines, n_dropped.

    Lines are cut at \\n; null or empty text is one empty line. A line's key is the line stripped of
    [\\x20\\x09-\\x0D] at both ends, with A-Z lower-cased. A key of min_chars code points or more that two documents
    hold loses all its lines except in the smallest doc_id; there all stay. Batches are ranges of doc_id in rising
    order, so that the first run that holds a key names its smallest doc_id; their number, 4 at least, grows with the
    square root of the bytes. Rows with a null doc_id lose nothing; rows that repeat a doc_id are one document. runs: those of a caller,
    who keeps them for later tables and drops them; lines that earlier tables hold go everywhere. Columns n_lines and
    n_dropped are replaced. Texts and lines of any length are read whole. Empty tables give empty results.
    """
    spark = docs.sparkSession
    ids = docs.where(F.col(key).isNotNull()).agg(F.sum(F.octet_length(text)).alias("n"), F.percentile_approx(F.col(key), [n / 1024 for n in range(1, 1024)], 10000).alias("cuts")).first()
    size = ids["n"] or 0
    if batches is None:
        batches = max(LEAST_BATCHES, math.isqrt(size // BATCH_BYTES))
    steps = ids["cuts"] or []
    edges = sorted({steps[min(n * 1024 // batches, 1023) - 1] for n in range(1, min(batches, 1024))}) if steps else []
    batch = F.lit(0)
    for edge in edges:
        batch = batch + (F.col("doc_id") > edge).cast("int")
    lines, lines_path = stored(line_hashes(docs, text, key, min_chars).withColumn("batch", batch), "lines", "batch")
    mine = runs or LineRuns(spark, fan_in, max(8, size // BUCKET_BYTES))
    try:
        for n in range(len(edges) + 1):
            mine.add(lines.where(F.col("batch") == n))
        drops = repeated_lines(lines, mine.all_runs(), mine.epoch).groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set("pos")).alias("drops"))
        drops, _ = stored(drops, "line-drops")
        mine.epoch += 1
    finally:
        if runs is None:
            mine.drop()
        forget(spark, lines_path)
    docs = docs.drop("n_lines", "n_dropped")
    row_id, text_id, gone = fresh(docs.columns, "_id", "_text_id", "_drops")
    whole = docs.withColumns({row_id: F.col(key), text_id: F.xxhash64(text)})
    marked = whole.join(drops.select(F.col("doc_id").alias(row_id), F.col("text_id").alias(text_id), F.col("drops").alias(gone)), [row_id, text_id], "left")
    cut = F.col(gone).isNotNull()
    return marked.select(
        *(c for c in docs.columns if c != text),
        F.when(cut, F.array_join(without(split_lines(F.col(text)), F.col(gone)), "\n")).otherwise(F.coalesce(text, F.lit(""))).alias(text),
        F.size(split_lines(F.col(text))).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    ).select(*docs.columns, "n_lines", "n_dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated lines; line_dedup states every case."""
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k.doc_id > f.first_doc) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.first_doc IS NULL OR k.doc_id <= f.first_doc), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
"""
