"""A corpus pipeline: language ID, line dedup, near-dedup, mixing of sources, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of docs. Counts of characters follow
the text where it is changed. No SQL expresses the stages (a parser, a tokenizer), so tests hold them against plain versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.language_id import identify, labelled_sample
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.near_dedup import near_dedup
from plumbline.llm.packing import pack
from plumbline.llm.source_mix import mix_sources
from plumbline.llm.work import BLANKS, documents, forget, stored

#: A text of LEAST_CHARS or more of which the best language's phrases are shorter than this on average is no text of any
#: labelled language: letters drawn at random had phrases of 1.2 to 1.6 symbols, check_s's documents 3.2 and more.
LEAST_PHRASE, LEAST_CHARS = 2.2, 200


def carried(docs: DataFrame, *columns: str, without: tuple[str, ...] = ()) -> DataFrame:
    """Some columns of docs, and the others (or all but `without`) as one struct _row, which no operator's own columns can clash with."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in without] or [F.lit(None).alias("none")]
    return docs.select(*columns, F.struct(*rest).alias("_row"))


def restored(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """docs' columns of carried rows, some of them new."""
    return rows.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty ones too) and those that no language's labelled text parses.

    Repeated rows are judged alike, an empty table stays empty, and columns of docs that identify would replace stay.
    """
    found = identify(carried(docs, "text", without=("text",)), labelled_sample(docs))
    spoken = (F.col("phrase_chars") >= LEAST_PHRASE) | (F.length("text") < LEAST_CHARS)
    return restored(found.where((F.col("lang_pred") != "und") & spoken), docs, text=F.col("text"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id holds; those that keep no visible text of what they had go.

    Null ids lose nothing, rows that repeat an id are one document, null text becomes empty, an empty table stays empty.
    """
    cut = line_dedup(carried(docs, "doc_id", "text", without=("text", "n_chars")))
    emptied = (F.col("n_dropped") > 0) & (F.length(F.btrim("text", F.lit(BLANKS))) == 0)
    return restored(cut.where(~emptied), docs, text=F.col("text"), n_chars=F.length("text").cast("long"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; rows with a null doc_id all stay.

    Rows are told apart by id and text, so an id that repeats with another text is judged by that text; rows that
    repeat both are one document. An empty table stays empty.
    """
    marks, _ = stored(near_dedup(docs).where("doc_id is not null").withColumnsRenamed({"doc_id": "_id", "text_id": "_text"}), "near-marks")
    gone = marks.where("not kept").select("_id", "_text").distinct()
    again = marks.where("kept").groupBy("_id", "_text").count().where("count > 1").select("_id", "_text")
    rows = carried(docs, "doc_id", "text").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), "_row")
    left = rows.join(gone, ["_id", "_text"], "left_anti")
    if not again.isEmpty():
        left = left.join(again, ["_id", "_text"], "left_anti").unionByName(left.join(again, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]))
    return left.select("_row.*")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target rate draws, in one random order; null sources are one source."""
    return mix_sources(carried(docs, "doc_id", "source")).select("_row.*")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens; null text is the one id 0."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language_stage), ("lines", line_stage), ("near", near_stage), ("mix", mix_stage), ("pack", pack_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if old:
            forget(spark, old)
        old = path
    return docs
