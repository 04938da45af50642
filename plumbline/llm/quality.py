"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import TABLE, alphanumerics, code_points, looked_up, lowered, slabs
from .work import documents, hashed_sample, held_out, ship

#: Classes of characters whose trigrams describe a text's form. Fixed: the commoner marks each, letters by case, digits, blanks, others.
MARKS = ".,!|#$%&*"
LOWER, UPPER, DIGIT, SPACE, NEWLINE, OTHER = range(len(MARKS), len(MARKS) + 6)
CLASSES = len(MARKS) + 6
FORM, WORDS, REPEATS = CLASSES**3, 512, 16
WIDTH = FORM + WORDS + REPEATS
#: Cosines this close are ties: 32-bit products of equal vectors may differ in their last bits.
TIE = 1e-5


@cache
def classes() -> np.ndarray:
    out = np.full(TABLE, OTHER, np.int16)
    out[alphanumerics()] = LOWER
    out[lowered() != np.arange(TABLE)] = UPPER
    out[[c for c in range(TABLE) if chr(c).isspace()]] = SPACE
    out[ord("0") : ord("9") + 1] = DIGIT
    out[ord("\n")] = NEWLINE
    for n, c in enumerate(MARKS):
        out[ord(c)] = n
    return out


def features(texts: list[str]) -> np.ndarray:
    """Counts of class trigrams, hashed words and repetition levels; a row a text.

    A word's hash sums its scrambled (place, character) pairs. The repetition level is the share of words that equal
    the word before, in REPEATS steps.
    """
    codes, sizes = code_points(texts)
    n, owner = len(texts), np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    kinds = looked_up(classes(), codes, OTHER)
    out = np.zeros((n, WIDTH), np.float32)
    if len(codes) >= 3:
        tri = (kinds[:-2] * np.int32(CLASSES) + kinds[1:-1]) * np.int32(CLASSES) + kinds[2:] + owner[2:] * np.int32(FORM)
        out[:, :FORM] = np.bincount(tri[owner[2:] == owner[:-2]], minlength=n * FORM).reshape(n, FORM)
    word = (kinds != SPACE) & (kinds != NEWLINE)
    begin = word.copy()
    begin[1:] &= ~word[:-1] | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(begin)
    if len(starts):
        bounds = np.concatenate([[0], starts, [len(codes)]])
        origin = np.repeat(bounds[:-1].astype(np.uint32), np.diff(bounds))
        place = np.arange(len(codes), dtype=np.uint32) - origin
        low = looked_up(lowered(), codes, 1)
        each = (low + place * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)
        each ^= each >> np.uint32(15)
        each *= word
        hashed = np.add.reduceat(each, starts, dtype=np.uint64)
        of = owner[starts]
        out[:, FORM : FORM + WORDS] = np.bincount(of.astype(np.int64) * WORDS + (hashed >> 8).astype(np.int64) % WORDS, minlength=n * WORDS).reshape(n, WORDS)
        total = np.bincount(of, minlength=n)
        again = np.bincount(of[1:], (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1]), n)
        level = np.minimum(again * REPEATS // np.maximum(total, 1), REPEATS - 1).astype(int)
        out[np.arange(n), FORM + WORDS + level] = total
    return out


class Voter:
    """Labelled vectors in the latent space, and what projects a text's counts there."""

    def __init__(self, weight: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int):
        self.weight, self.basis, self.vectors, self.labels, self.neighbours = weight, basis, vectors, labels, neighbours
        self.prior = float(labels.mean()) if len(labels) else 0.5

    @staticmethod
    def weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Logarithmic counts, each block of features scaled to length 1, times the inverse document frequency."""
        x = np.log1p(counts) * weight
        for low, high in ((0, FORM), (FORM, FORM + WORDS), (FORM + WORDS, WIDTH)):
            part = x[:, low:high]
            part /= np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-9)
        return x

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, rank: int = 48, neighbours: int = 25, seed: int = 5) -> Voter:
        labels = np.asarray(labels, np.float32)
        if not len(labels):
            return cls(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), labels, neighbours)
        weight = np.log((1 + len(labels)) / (1 + (counts > 0).sum(0))).astype(np.float32)
        x = cls.weighted(counts, weight)
        rank = min(rank, *x.shape)
        probe = x.T @ (x @ np.random.default_rng(seed).standard_normal((WIDTH, rank + 8)).astype(np.float32))
        for _ in range(3):
            probe = x.T @ (x @ np.linalg.qr(probe)[0])
        q = np.linalg.qr(probe)[0]
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        basis = (q @ vt[:rank].T).astype(np.float32)
        return cls(weight, basis, cls.unit(x @ basis), labels, neighbours)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest labelled vectors, weighted by the fourth power of their cosines; the prior where nothing is similar.

        Nearest are the `neighbours` of greatest cosine and all that tie with the last of them.
        """
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        x = self.unit(self.weighted(counts, self.weight) @ self.basis)
        near = x @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        last = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        sim = np.where(near >= last - TIE, np.maximum(near, 0), 0) ** 4
        return np.clip(sim @ self.labels + 1e-6 * self.prior, 0, None) / (sim.sum(1) + 1e-6)


def labelled_counts(docs: DataFrame, labels: DataFrame, rows: int, text: str, label: str, key: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature counts, labels) of a bounded sample: of each label the `rows` documents of lowest hashed id, whole texts of any length.

    Null is empty text. An id with both labels counts as 1; rows that repeat an id teach once, with the least text.
    Texts become counts where they lie, so that what reaches the driver is bounded by the rows.
    """
    spark = docs.sparkSession
    marks = labels.where(~held_out(F.col(key)) & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    drawn = hashed_sample(marks, "y", "k", rows)
    wanted = {r.k: r.y for y in (0, 1) for r in [r for r in drawn if r.y == y][:rows]}
    if not wanted:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0, np.float32)
    ids = F.broadcast(spark.createDataFrame([(k,) for k in wanted], marks.select("k").schema))
    some = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).join(ids, "k")
    one = some.select("k", "t", F.xxhash64("t").alias("h")).groupBy("k", "h").agg(F.first("t").alias("t")).groupBy("k").agg(F.min_by("t", "h").alias("t"))
    ship(spark)

    @F.pandas_udf("binary")
    def counted(texts: pd.Series) -> pd.Series:
        out = []
        for _, part in slabs(texts.tolist(), 2_000_000, 512):
            out += [x.tobytes() for x in features(part)]
        return pd.Series(out)

    got = sorted((r.k, r.c) for r in one.select("k", counted("t").alias("c")).collect())
    return np.frombuffer(b"".join(c for _, c in got), np.float32).reshape(-1, WIDTH), np.array([wanted[k] for k, _ in got], np.float32)


def score_quality(docs: DataFrame, voter: Voter, text: str = "text") -> DataFrame:
    """docs with a column score, 0 to 1: the similarity-weighted vote of each whole text's nearest labelled vectors.

    The labelled vectors are broadcast: at most 2 * rows of them, a bound that fit_voter keeps. Every text, of any
    length, meets all of them as one block of cosines, and all that tie at the last place vote. Null is empty text; a text
    without features gets the labels' mean. Rows are independent, so repeated rows get equal scores; a column score is
    replaced; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(voter)

    @F.pandas_udf("double")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = [x or "" for x in texts]
            out = np.zeros(len(texts))
            for start, part in slabs(texts, 2_000_000, 512):
                out[start : start + len(part)] = sent.value.score(features(part))
            yield pd.Series(out)

    return docs.withColumn("score", vote(F.col(text)))


def fit_voter(docs: DataFrame, labels: DataFrame, rows: int = 1500, text: str = "text", label: str = "quality", key: str = "doc_id") -> Voter:
    """A voter of at most 2 * rows labelled texts, drawn by labelled_counts from rows that are not held out.

    Labels other than 0 and 1 (null too) and null ids teach nothing; without any label every score is 0.5.
    """
    return Voter.fit(*labelled_counts(docs, labels, rows, text, label, key))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the vote of labelled ones that are not held out; score_quality states every case."""
    docs = documents(spark, sf_dir)
    voter = fit_voter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_quality(docs.select("doc_id", "text"), voter)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
