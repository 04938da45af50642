"""Exact duplicate groups by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import LINE_BLANKS, SortedRun, documents, sorted_scans, stored

#: Rows of a bucket of a run that a task sorts and merges.
BUCKET_ROWS = 1_000_000


def digest_rows(docs: DataFrame, runs: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, digest, proof, n_chars, run): SHA-256 of the text with each blank run made one space; null text counts as empty.

    proof is a second, independent hash of the same text; the reading tasks are dealt to `runs` groups.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), LINE_BLANKS, " ")
    return docs.select(
        F.col(key).alias("doc_id"), F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"), F.xxhash64(norm).alias("proof"), F.length(norm).alias("n_chars"), (F.spark_partition_id() % runs).alias("run")
    )


def first_run(rows: DataFrame, buckets: int) -> SortedRun:
    """One partition group's run: a row for each digest with its smallest identifier and its rows, sorted by digest."""
    node = rows.groupBy("digest", "proof", "n_chars").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return SortedRun(node, "digest", buckets, "digest-run", dealt=True)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sorted runs as one: rows whose digest, second hash and length all agree keep the smaller identifier and the summed size.

    The digest alone is the join's key, as the runs are bucketed and sorted by it; the rest verifies the rows that meet.
    """
    a, b = a.alias("a"), b.alias("b")
    verified = (F.col("a.proof").bitwiseXOR(F.col("b.proof")) == 0) & (F.col("a.n_chars") - F.col("b.n_chars") == 0)
    pairs = a.join(b, (F.col("a.digest") == F.col("b.digest")) & verified, "full_outer")
    zero = F.lit(0).cast("long")
    return pairs.select(
        *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("digest", "proof", "n_chars")),
        F.least("a.keep_id", "b.keep_id").alias("keep_id"), (F.coalesce("a.group_size", zero) + F.coalesce("b.group_size", zero)).alias("group_size"),
    )


def tree_merge(rows: DataFrame, runs: int, buckets: int) -> tuple[DataFrame, str]:
    """The merged run of all rows, stored, with its path: in round r, run i takes in run i + 2^r, for i in steps of 2^(r+1).

    A run is a bucketed, sorted table; a merge is a full outer merge join of two such tables, bucket by bucket, without an
    exchange or a sort of its inputs, and gives a sorted run again. A digest that a third of all rows share is one row
    of each run before it is first moved.
    """
    spark = rows.sparkSession
    held: dict[int, SortedRun] = {}
    try:
        with sorted_scans(spark):
            for i in range(runs):
                held[i] = first_run(rows.where(F.col("run") == i), buckets)
            step = 1
            while step < runs:
                for i in range(0, runs - step, 2 * step):
                    one, two = held[i], held.pop(i + step)
                    held[i] = SortedRun(merged(one.rows(), two.rows()), "digest", buckets, "digest-run")
                    one.drop()
                    two.drop()
                step *= 2
            return stored(held[0].rows(), "digest-groups")
    finally:
        for run in held.values():
            run.drop()


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", runs: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of [\\x20\\x09-\\x0D] is one space; null text is empty text. Of equal
    texts the smallest doc_id stays. Rows that repeat a doc_id share its decision: each is marked kept if the id is the
    group's smallest. A null doc_id is never the smallest unless all ids of its group are null; then keep_id is null
    and its rows are kept. Other columns are not read. Texts of any length are hashed whole. An empty table gives an
    empty result. runs: partition groups that become digest runs; by default as many as grow with the logarithm of the
    rows, 4 to 64. Runs have a bucket for each million rows; more partitions make more.
    """
    spark = docs.sparkSession
    n = docs.select(key).count()
    if runs is None:
        runs = min(64, max(4, 1 << max(0, (n // (4 * BUCKET_ROWS)).bit_length() - 1)))
    rows, _ = stored(digest_rows(docs, runs, text, key), "digest-rows", "run")
    buckets = max(4, -(-n // (runs * BUCKET_ROWS // 4)))
    groups, _ = tree_merge(rows, runs, buckets)
    same = ["digest", "proof", "n_chars"]
    return rows.join(groups, same).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicate groups of all documents; exact_dedup states every case."""
    return exact_dedup(documents(spark, sf_dir))


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
