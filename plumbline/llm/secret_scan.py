"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import documents, forget, shared_folder, stored


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern whose `group` has `least` characters or more. rank orders kinds."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    rank: int = 0


#: The base kinds of the contract. A run of [0-9a-f] or AKIA[A-Z0-9] of the least length is found as such, since shorter runs hold no longer one.
BASE_RULES = (
    Rule("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, 0),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16, 1),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32, 2),
)
#: What the ledger's rules add to the base kinds.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1, 3),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, 4),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, 5),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, 6),
)
RULES = BASE_RULES + MORE_RULES

SPAN = "struct<start:int,rank:int,end:int,kind:string>"
#: A ledger row says that a blob was scanned by one version of one rule, and what was found.
LEDGER_SCHEMA = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("rule", T.StringType())])


def rule_version(rule: Rule) -> str:
    return f"{rule.kind}-{rule.version}"


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class Ledger:
    """Scanned (blob, rule version) pairs in a folder, a subfolder a rule version. Scans read it and append to it.

    path None: a new folder in the shared folder. A new version of a rule, or a new rule, is a pair that no row holds.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}"

    def rows(self) -> DataFrame:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path)

    def add(self, rows: DataFrame) -> None:
        rows.select(*LEDGER_SCHEMA.names).write.mode("append").option("compression", "zstd").partitionBy("rule").parquet(self.path)


def scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, gaps, sizes, graded) of blobs (blob, content, todo), a row for each rule version in todo.

    gaps, sizes and graded are, for each match, the code points before it since the last one, its own, and those of its
    graded group. All matches are counted in one pass over the text each; no list grows match by match.
    """
    none = F.lit(None).cast("array<int>")

    def one(rule: Rule) -> Column:
        text, pattern, name = F.col("content"), F.lit(rule.pattern), rule_version(rule)
        sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
        graded = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else none
        gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
        hit = text.rlike(rule.pattern)
        row = F.struct(F.lit(name).alias("rule"), F.when(hit, gaps).otherwise(none).alias("gaps"), F.when(hit, sizes).otherwise(none).alias("sizes"), F.when(hit, graded).otherwise(none).alias("graded"))
        return F.when(F.array_contains("todo", name), row)

    each = F.filter(F.array(*(one(rule) for rule in rules)), lambda x: x.isNotNull())
    return blobs.select("blob", F.explode(each).alias("x")).select("blob", "x.*")


def placed(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of scanned rows. The places of a text's matches are running sums over its matches, one row each."""
    least = F.create_map(*(F.lit(x) for r in rules for x in (rule_version(r), r.least)))
    graded = F.coalesce("graded", "sizes")
    matches = found.where(F.col("sizes").isNotNull()).select("blob", "rule", F.posexplode(F.arrays_zip(F.slice("gaps", 1, F.size("sizes")).alias("gap"), F.col("sizes").alias("size"), graded.alias("graded"))).alias("n", "m"))
    before = Window.partitionBy("blob", "rule").orderBy("n")
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(before).cast("int")
    spans = matches.select("blob", "rule", "m.graded", (end - F.col("m.size")).alias("start"), end.alias("end")).where(F.col("graded") >= least[F.col("rule")])
    spans = spans.groupBy("blob", "rule").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return found.select("blob", "rule").join(spans, ["blob", "rule"], "left").select("blob", F.coalesce("spans", empty).alias("spans"), "rule")


def scan_versions(versions: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan a table of paths' versions: (its rows with blob and spans, the ledger rows added).

    A version's blob is the SHA-256 of its text; null text is empty text. Each (blob, rule version) pair that the
    ledger does not hold is scanned once, however many rows share it, and becomes a ledger row; findings of these rules
    are joined back to every row of the blob, by start, then rank of the kind. Text is moved once, to meet its copies.
    ledger None is a new one. Texts of any length and any number of matches are scanned whole. All columns of versions
    stay but `blob` and `spans`, which are replaced. An empty table gives an empty result and adds nothing.
    """
    spark = versions.sparkSession
    ledger = Ledger(spark) if ledger is None else ledger
    names = [rule_version(r) for r in rules]
    known = ledger.rows().where(F.col("rule").isin(names))
    contents = versions.select(address(F.col(text)).alias("blob"), F.coalesce(text, F.lit("")).alias("content"))
    blobs = contents.groupBy("blob").agg(F.first("content").alias("content"))
    todo = F.array(*map(F.lit, names))
    if not known.isEmpty():
        seen = known.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    else:
        blobs = blobs.withColumn("todo", todo)
    found, found_path = stored(scanned(blobs.select("blob", "content", "todo"), rules), "secret-matches")
    fresh, _ = stored(placed(found, rules), "secret-spans")
    forget(spark, found_path)
    ledger.add(fresh)
    kind = F.create_map(*(F.lit(x) for r in rules for x in (rule_version(r), r.kind)))[F.col("rule")]
    rank = F.create_map(*(F.lit(x) for r in rules for x in (rule_version(r), r.rank)))[F.col("rule")]
    hits = ledger.rows().where(F.col("rule").isin(names) & (F.size("spans") > 0)).select("blob", kind.alias("kind"), rank.alias("rank"), "spans")
    hits = hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), s["end"].alias("end"), F.col("kind").alias("kind"))).alias("s"))
    hits = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("spans"))
    on = versions.drop("blob", "spans").withColumn("blob", address(F.col(text))).join(hits, "blob", "left")
    return on.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))), fresh


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, from a new ledger; scan_versions states every case."""
    found, _ = scan_versions(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    count = {f"n_{r.kind}": F.size(F.filter(F.transform("spans", lambda s: s["rank"]), lambda rank: rank == r.rank)).cast("long") for r in BASE_RULES}
    return found.select("doc_id", *(v.alias(k) for k, v in count.items()), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _kind_sql(rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rule.rank} AS rank, '{rule.kind}' AS kind, ms, gs, gaps FROM (
    SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {rule.group}) AS gs, string_split_regex(t, '{p}') AS gaps FROM d) WHERE len(ms) > 0"""


OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_kind_sql(r) for r in RULES)}),
e AS (
  SELECT doc_id, rank, kind, i,
    list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)::BIGINT AS s, length(ms[i]) AS n, length(gs[i]) AS g
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)
), s AS (
  SELECT * FROM e WHERE g >= CASE kind {" ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)} END
), a AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (WHERE rank < {len(BASE_RULES)}), '') AS base,
    string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
