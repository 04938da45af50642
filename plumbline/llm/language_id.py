"""Language identification by cross-parsing entropy against suffix automata of labelled text."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import code_points, letters, looked_up, lowered, slabs
from .work import claim, documents, fresh, hashed_sample, held_out, ship

#: Symbols are the UTF-8 bytes of lower-cased letters; a run of other characters is one GAP. Bytes that no letter has stand for these.
PAD, GAP, BREAK = 0, 1, 255
BLOCK = 256


def labelled_sample(docs: DataFrame, text_chars: int = 32_000, rows: int = 400, total_chars: int = 1_000_000, text: str = "text", lang: str = "lang", key: str = "doc_id") -> list[tuple[str, str]]:
    """(language, text) of labelled texts that are not held out: the bounded sample that the parsers learn.

    Of each language the `rows` documents of lowest hashed id are taken in that order until their code points reach
    text_chars, or total_chars over the number of languages where that is less. A text of more than a quarter of that
    teaches a window of a quarter, which begins at a place drawn by its id, so that languages of long texts alone are
    learned too. Any number of languages is learned. Rows that repeat an id teach once.
    """
    spark = docs.sparkSession
    known = docs.where(~held_out(F.col(key)) & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    drawn = hashed_sample(known.select("k", "l"), "l", "k", rows)
    if not drawn:
        return []
    most = max(min(text_chars, total_chars // len({r.l for r in drawn})), 4)
    schema = known.select("k", "l").schema
    ranked = known.join(F.broadcast(spark.createDataFrame([(r.k, r.l) for r in drawn], schema)), ["k", "l"])
    size = {(r.k, r.l): r.n for r in ranked.groupBy("k", "l").agg(F.min(F.length("t")).alias("n")).collect()}
    total: dict = defaultdict(int)
    number: dict = defaultdict(int)
    chosen = []
    for r in drawn:
        if total[r.l] < most and number[r.l] < rows:
            total[r.l] += min(size[r.k, r.l], most // 4)
            number[r.l] += 1
            chosen.append((r.k, r.l))
    begin = F.pmod(F.xxhash64("k", F.lit(3)), F.greatest(F.length("t") - most // 4, F.lit(0)) + 1).cast("int") + 1
    got = known.join(F.broadcast(spark.createDataFrame(chosen, schema)), ["k", "l"]).select("k", "l", F.substr("t", begin, F.lit(most // 4)).alias("t"))
    return sorted((r.l, r.t) for r in got.groupBy("k", "l").agg(F.min("t").alias("t")).collect())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the smallest automaton that accepts every substring; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for s in symbols:
        new = len(go)
        go.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and s not in go[at]:
            go[at][s] = new
            at = link[at]
        if at >= 0:
            to = go[at][s]
            if longest[to] == longest[at] + 1:
                link[new] = to
            else:
                twin = len(go)
                go.append(dict(go[to]))
                longest.append(longest[at] + 1)
                link.append(link[to])
                while at >= 0 and go[at].get(s) == to:
                    go[at][s] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return go


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols on end, and the number of symbols of each."""
    codes, sizes = code_points(texts)
    low = looked_up(lowered(), codes, 0) if len(codes) else codes
    word = looked_up(letters(), codes, False)
    ends = np.cumsum(sizes)
    begin = np.ones(len(codes), bool)
    begin[1:] = word[:-1]
    begin[(ends - sizes)[sizes > 0]] = True
    out = np.where(word, low, GAP).astype(np.uint32)[word | begin]
    wide = 1 + (out > 0x7F).astype(np.int64) + (out > 0x7FF) + (out > 0xFFFF)
    kept = np.concatenate([[0], np.cumsum(word | begin)])
    at = np.concatenate([[0], np.cumsum(wide)])
    spelled = np.frombuffer(out.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    return spelled, at[kept[ends]] - at[kept[ends - sizes]]


class Model:
    """One language's automaton as a table [state * width + class] of next state's row and, in the lowest bit, whether a phrase begins.

    classes gives each symbol's class; symbols that the labelled text lacks share one that no state goes on from. In
    the start state no phrase is open. PAD leaves everything as it is.
    """

    def __init__(self, texts: list[str]):
        parts = [symbols([t])[0].tolist() for t in texts]
        whole = [x for part in parts for x in (*part, BREAK)]
        seen = sorted(set(whole) - {BREAK})
        self.classes = np.full(256, len(seen) + 1, np.int32)
        self.classes[PAD] = 0
        for n, s in enumerate(seen, 1):
            self.classes[s] = n
        go, width = suffix_automaton(whole), len(seen) + 2
        first = np.zeros(width, np.int32)
        for s, to in go[0].items():
            if s != BREAK:
                first[self.classes[s]] = to
        table = np.broadcast_to((first * width) << 1 | 1, (len(go), width)).copy()
        classes = self.classes.tolist()
        for state, out in enumerate(go[1:], 1):
            for s, to in out.items():
                if s != BREAK:
                    table[state, classes[s]] = (to * width) << 1
        table[:, 0] = (np.arange(len(go), dtype=np.int32) * width) << 1
        self.table, self.bits = table.ravel(), math.log2(len(whole) + 2)

    def phrases(self, grid: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases of each column of symbols; a column that is not `first` of its text goes on from the column before.

        All columns are parsed at once from the start state. Then those whose predecessor ends elsewhere are parsed again
        from there, as far as their states differ, which is some phrases; until every column began where it should.
        """
        steps = self.classes[grid]
        row, count = np.zeros(grid.shape[1], np.int32), np.zeros(grid.shape[1], np.int64)
        path = np.empty(grid.shape, np.int32)
        for n, step in enumerate(steps):
            path[n] = x = self.table[row + step]
            count += x & 1
            row = x >> 1
        begun = np.zeros(grid.shape[1], np.int32)
        while True:
            wanted = np.where(first, 0, np.concatenate([row[:1] * 0, row[:-1]]))
            todo = np.flatnonzero(wanted != begun)
            if not len(todo):
                return count
            begun[todo] = wanted[todo]
            now = wanted[todo]
            for n in range(len(grid)):
                x, old = self.table[now + steps[n, todo]], path[n, todo]
                path[n, todo] = x
                count[todo] += (x & 1) - (old & 1)
                apart = x >> 1 != old >> 1
                now, todo = x[apart] >> 1, todo[apart]
                if not len(todo):
                    break
            row[todo] = now


class Parser:
    """Counts the phrases that parse texts by longest matches in each language's labelled text."""

    def __init__(self, sample: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in sample})
        self.models = [Model([t for lang, t in sample if lang == name]) for name in self.languages]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (rows) in each language (columns), and the texts' symbols."""
        spelled, sizes = symbols(texts)
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        grid = np.full((int(blocks.sum()), BLOCK), PAD, np.uint8)
        starts = np.cumsum(sizes) - sizes
        grid.ravel()[np.arange(len(spelled)) + np.repeat(first * BLOCK - starts, sizes)] = spelled
        grid = np.ascontiguousarray(grid.T)
        out = np.zeros((len(texts), len(self.models)))
        owner = np.repeat(np.arange(len(texts)), blocks)
        begins = np.zeros(len(owner), bool)
        begins[first[blocks > 0]] = True
        for n, model in enumerate(self.models):
            out[:, n] = np.bincount(owner, model.phrases(grid, begins), len(texts))
        return out, sizes

    def predict(self, texts: list[str]) -> pd.DataFrame:
        got = pd.DataFrame({"lang_pred": np.full(len(texts), "und", object), "score": 0.0, "phrase_chars": 0.0})
        if not self.models:
            return got
        cost = np.array([m.bits for m in self.models])
        for start, part in slabs(texts):
            count, sizes = self.phrases(part)
            bits = count * cost
            best = bits.argmin(1)
            codes, chars = code_points(part)
            seen = np.concatenate([[0], np.cumsum(looked_up(letters(), codes, False))])
            ends = np.cumsum(chars)
            some = seen[ends] > seen[ends - chars]
            share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
            rows = slice(start, start + len(part))
            got.loc[got.index[rows], "lang_pred"] = np.where(some, np.array(self.languages, object)[best], "und")
            got.loc[got.index[rows], "score"] = np.where(some, share, 0.0)
            got.loc[got.index[rows], "phrase_chars"] = np.where(some, sizes / np.maximum(count.min(1), 1), 0.0)
        return got


@lru_cache(2)
def parser(sample: tuple[tuple[str, str], ...]) -> Parser:
    """One parser a Python worker."""
    return Parser(list(sample))


def identify(docs: DataFrame, sample: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """docs with lang_pred, score and phrase_chars; columns of those names are replaced.

    Every whole text is parsed greedily: a phrase is the longest match of what follows anywhere in a language's
    labelled text. The language whose phrases cost the fewest bits (phrases times the logarithm of its labelled
    length) wins; equal costs go to the first name. score is the winner's share if bits are read as log-likelihoods,
    phrase_chars the symbols (bytes of letters, and gaps) a phrase. lang_pred is und (score 0) where text is null or has
    no letter, or no labelled text exists. Rows are independent, so repeated rows get equal answers; an empty table
    gives an empty result. Very long texts are parsed whole, in blocks that go on from one another.
    """
    ship(docs.sparkSession)
    known = tuple(sample)

    @F.pandas_udf("lang_pred string, score double, phrase_chars double")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("language", parser.cache_clear)
        for texts in batches:
            yield parser(known).predict([x or "" for x in texts])

    kept = docs.drop("lang_pred", "score", "phrase_chars")
    (parsed,) = fresh(docs.columns, "_parsed")
    return kept.withColumn(parsed, parse(F.col(text))).select(*kept.columns, f"{parsed}.lang_pred", f"{parsed}.score", f"{parsed}.phrase_chars")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from labelled ones that are not held out; identify states every case."""
    docs = documents(spark, sf_dir)
    out = identify(docs.select("doc_id", "text"), labelled_sample(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "phrase_chars")
