"""Best-fit-decreasing packing of tokenised documents into sequences."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import ChainMap, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chars import slabs
from .work import claim, documents, keyed_texts, ship, stored

CAPACITY = 2048
#: Words kept with their ids in each Python worker, and the longest that are.
WORDS_KEPT, LONGEST_KEPT = 600_000, 40
CUT = re.compile(r"(?<=\S)(?= )")
HARD = re.compile(r"[^\S ] |  ")


def vocabulary_bytes(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Byte-level tokens as bytes: printable Latin-1 stands for itself, other bytes for code points from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(byte_of[c] for c in token): n for token, n in vocabulary.items() if all(c in byte_of for c in token)}


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes, equal to those of the tokenizer file.

    A byte-level tokenizer never joins a blank to what stands before it, so a text is cut before each space that
    follows a visible character, and the ids of its words are looked up or made once. A faster library makes them from
    the file's vocabulary if it agrees with the tokenizer on a probe; one new word in CHECKED, drawn by hash, is made by
    both, and a difference raises ValueError. exact: the tokenizer itself makes all.
    """

    PROBE = "It's 12 o'clock; naïve  façade\n\n\tword's -- x_1 y <|endoftext|> ça va?  \n z"
    CHECKED = 16

    def __init__(self, file: bytes, exact: bool = False):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.fast = Tokenizer.from_buffer(file), None
        self.words: dict[str, bytes] = {}
        if not exact:
            self.fast = self.faster(json.loads(file))

    def faster(self, made: dict):
        """The faster library's encoder of the same vocabulary, or None."""
        special = {x["content"]: x["id"] for x in made.get("added_tokens", [])}
        try:
            import public_tokenizers
            import tiktoken

            ranks = {k: v for k, v in vocabulary_bytes(made["model"]["vocab"]).items() if v not in special.values()}
            fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        except (ImportError, ValueError, KeyError):
            return None
        return fast if fast.encode(self.PROBE, allowed_special="all") == self.tokenizer.encode(self.PROBE, add_special_tokens=False).ids else None

    @staticmethod
    def cut(text: str) -> list[str]:
        if text[:1] == " " or HARD.search(text):
            return CUT.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]

    def exactly(self, words: list[str]) -> dict[str, bytes]:
        return {w: array("I", x.ids).tobytes() for w, x in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False))}

    def made(self, word: str) -> bytes:
        """A new word's ids by the faster library, kept if it is short, and checked later if it is drawn."""
        out = array("I", self.fast.encode(word, allowed_special="all") if "<" in word else self.fast.encode_ordinary(word)).tobytes()
        if zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.CHECKED == 0:
            self.drawn[word] = out
        if len(word) <= LONGEST_KEPT:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            self.words[word] = out
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """All texts' ids."""
        if self.fast is None:
            cuts = [self.cut(t) for t in texts]
            known = self.exactly(list({w for words in cuts for w in words if w not in self.words}))
            get = ChainMap(self.words, known).__getitem__
            out = [b"".join(map(get, words)) for words in cuts]
            self.words.update((w, x) for w, x in known.items() if len(w) <= LONGEST_KEPT)
            if len(self.words) > WORDS_KEPT:
                self.words.clear()
            return out
        self.drawn: dict[str, bytes] = {}
        get, made, cut = self.words.get, self.made, self.cut
        out = [b"".join([get(w) or made(w) for w in cut(t)]) for t in texts]
        for word, ids in self.exactly(list(self.drawn)).items():
            if ids != self.drawn[word]:
                raise ValueError(f"the faster encoder differs from the tokenizer on {word!r}: pack with exact=True")
        return out


@lru_cache(1)
def encoder(file: bytes, exact: bool) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(file, exact)


PIECES = "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, text: str, key: str, exact: bool) -> DataFrame:
    """Rows PIECES: each document's ids and a last id 0, cut into pieces of capacity of which the first may be shorter.

    part is the task, nth the piece's number among those of its length in that task.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("packing", encoder.cache_clear)
        encode, task = encoder(sent.value, exact).ids, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            texts = [x or "" for x in batch["text"]]
            coded = (ids for _, part in slabs(texts, 1_000_000) for ids in encode(part))
            for doc, no_id, ids in zip(batch["doc_id"], batch["no_id"], coded):
                ids += b"\0\0\0\0"
                n, start = len(ids) // 4, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    rows.append((doc, no_id, 0 if start == 0 else rows[-1][2] + 1, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
                    start += length
            yield pd.DataFrame(rows, columns=["doc_id", "no_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return keyed_texts(docs, text, key).mapInPandas(cut, PIECES)


class Capacities:
    """A segment tree over remaining capacities 0..top that tells the smallest one, at or above a size, with open bins."""

    def __init__(self, top: int):
        self.width = 1 << top.bit_length()
        self.some = [False] * (2 * self.width)

    def mark(self, at: int, some: bool) -> None:
        at += self.width
        self.some[at] = some
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def tightest(self, size: int) -> int | None:
        at = size + self.width
        if self.some[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of counts[length] pieces, as runs (length, first piece, pieces, first bin, offset).

    Equal pieces are interchangeable, so bins of equal remaining capacity are kept as intervals of bin numbers and
    equal pieces are placed many at a time: piece first + i of a run goes into bin first + i. That is the placement
    that one search of the tree a piece would make: the tightest open bin takes pieces of a length until it has no room
    for another, as it stays the tightest.
    """
    tree, open_bins, bins = Capacities(capacity), defaultdict(list), 0
    runs = []

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_bins[remaining].append((first, n))
            tree.mark(remaining, True)

    for size in sorted(counts, reverse=True):
        done, total = 0, counts[size]
        while done < total:
            left = total - done
            room = tree.tightest(size)
            if room is None:
                room, first, n = capacity, bins, left
            else:
                first, n = open_bins[room].pop()
                tree.mark(room, bool(open_bins[room]))
            each = room // size
            whole = min(n, left // each)
            for k in range(each if whole else 0):
                runs.append((size, done, whole, first, capacity - room + k * size))
                done += whole
            used = whole
            if used < n and 0 < total - done < each:
                for k in range(total - done):
                    runs.append((size, done, 1, first + used, capacity - room + k * size))
                    done += 1
                put(room - (k + 1) * size, first + used, 1)
                used += 1
            put(room - each * size, first, whole)
            if first == bins:
                bins += used
            else:
                put(room, first + used, n - used)
    return runs


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", exact: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    All pieces of the table are packed together, best fit in order of falling length. Only the number of pieces of
    each length, at most `capacity` numbers, comes to the driver, which places them (best_fit_runs); a piece finds its
    place by its rank among the pieces of its length. Texts of any length are encoded whole; exact: by the
    tokenizer itself, word by word (see Encoder). Null text is empty text: the one id 0. Rows with null or
    repeated doc_id are packed like others. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    pieces, _ = stored(cut_pieces(docs, tokenizer, capacity, text, key, exact), "pieces")
    per_task, _ = stored(pieces.groupBy("length", "part").count(), "piece-counts")
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = per_task.select("length", "part", before.alias("before")).hint("merge")  # tasks times lengths: grows with the input, so never broadcast
    ranked = pieces.join(firsts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    counts = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("count")).collect()}
    runs = np.array(sorted(best_fit_runs(counts, capacity)), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(runs)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = sent.value
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for b in batches:
            rank = b.pop("rank").to_numpy(np.int64)
            at = np.searchsorted(keys, (b["length"].to_numpy(np.int64) << 48) + rank, "right") - 1
            yield b.assign(sequence_id=runs[at, 3] + rank - runs[at, 1], offset=runs[at, 4])

    columns = ["doc_id", "no_id", "piece", "start", "length", "ids_crc32"]
    placed = ranked.select(*columns, "rank").mapInPandas(place, "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens; pack states every case."""
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
