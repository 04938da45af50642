"""Removal of byte strings that repeat anywhere in the corpus, by sorting sparse suffixes in dealt buckets.

The suffixes sorted are those that begin at anchors: a 200-byte window's anchor is its leftmost smallest 40-byte gram by
hash, so equal windows have equal anchors at equal places. Windows in a row with one anchor are one record: its suffix
(the bytes from the anchor to the end of its last window), and what stands before the anchor, read backwards. The gram is
the suffix's leading token. Records whose token occurs once in the corpus drop out by a hash filter, which may keep
too many but loses none. The others are dealt to buckets by ranges of their bytes, with splitters from a sample
(Spark's range partitioning); a bucket sorts its suffixes by multikey quicksort and compares neighbours byte by byte.
What a bucket's border cuts apart meets again in buckets of another order. No result rests on a hash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import mixed
from .work import claim, documents, forget, keyed_texts, setting, shared_folder, ship, stored

GRAM = 40
#: Bytes of a part; of text for a bucket of the token filter and of the chunk table; records of a bucket of suffixes.
PART, BUCKET_BYTES, BUCKET_ROWS = 2_000_000, 64_000_000, 100_000
#: Records sampled for each bucket's splitter; they come to the driver, some 400 bytes each.
SAMPLES = 20
#: Bits of a gram's hash that give way to its place when the smallest is sought; parts are shorter than 2^24.
PLACE = np.uint64(24)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
BYTE = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    out = _POWERS.get(base, np.ones(1, np.uint64))
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
        _POWERS[base] = out
    return out[:n]


def anchored(body: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, token) of each run of windows that share an anchor; lengths: of the documents in body."""
    n, grams = len(body), len(body) - GRAM + 1
    if n < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[body] * _powers(INVERSE, n), dtype=np.uint64)])
    token = mixed((prefix[GRAM:] - prefix[:-GRAM]) * _powers(BASE, grams))
    key = (token >> PLACE << PLACE) | np.arange(grams, dtype=np.uint64)
    reach, span = width - GRAM + 1, 1
    while 2 * span <= reach:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    windows = n - width + 1
    key = np.minimum(key[:windows], key[reach - span : reach - span + windows])
    anchor = (key & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    inside = np.ones(windows, bool)
    for end in np.cumsum(lengths)[:-1]:
        inside[max(end - width + 1, 0) : end] = False
    change = np.ones(windows, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], windows) - 1
    real = inside[first]
    first, last = first[real], last[real]
    return first, last, anchor[first], mixed(token[anchor[first]] + np.uint64(BASE))


CHUNKS = "piece long, chunk long, parts int, base long, own long, doc_ids array<long>, lengths array<long>, body binary, runs binary, tokens binary"


def chunked(docs: DataFrame, width: int, text: str, key: str, size: int = PART) -> DataFrame:
    """Rows CHUNKS: documents' UTF-8 bytes, compressed, with their runs. A chunk is whole documents of about `size` bytes in one piece, or one longer document in several.

    A piece's body is its own bytes and, where its document goes on, the width - 1 bytes that its last windows cover.
    """
    ship(docs.sparkSession)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("suffix", _POWERS.clear)
        squeeze, number = zstandard.ZstdCompressor(3), TaskContext.get().partitionId() << 32

        def row(piece: int, chunk: int, parts: int, base: int, own: int, ids: list, lengths: list, body: bytes) -> pd.DataFrame:
            x = np.frombuffer(body, np.uint8)
            first, last, anchor, token = anchored(x, np.array(lengths if parts == 1 else [len(x)], np.int64), width)
            runs = np.array([first, last - first, anchor - first], np.uint32).tobytes()
            return pd.DataFrame({"piece": [piece], "chunk": [chunk], "parts": [parts], "base": [base], "own": [own], "doc_ids": [ids], "lengths": [lengths], "body": [squeeze.compress(body)], "runs": [squeeze.compress(runs)], "tokens": [token.tobytes()]})

        ids, held, total = [], [], 0
        for batch in batches:
            for doc, no_id, whole in zip(batch["doc_id"], batch["no_id"], batch["text"]):
                raw = whole.encode("utf-8", "surrogatepass") if whole else b""
                if held and total + len(raw) > size:
                    yield row(number, number, 1, 0, total, ids, [len(x) for x in held], b"".join(held))
                    ids, held, total, number = [], [], 0, number + 1
                name = None if no_id else int(doc)
                if len(raw) > size:
                    chunk, parts = number, -(-len(raw) // size)
                    for n, base in enumerate(range(0, len(raw), size)):
                        yield row(number, chunk, parts, base, min(size, len(raw) - base), [name] if n == 0 else [], [len(raw)] if n == 0 else [], raw[base : base + size + width - 1])
                        number += 1
                else:
                    ids.append(name)
                    held.append(raw)
                    total += len(raw)
        if held:
            yield row(number, number, 1, 0, total, ids, [len(x) for x in held], b"".join(held))

    return keyed_texts(docs, text, key).mapInPandas(pack, CHUNKS)


TOKENS = "bucket int, piece long, tokens binary, twice binary"
SHARED = "piece long, bucket int, n int, shared binary"


def token_rows(rows: pd.DataFrame, bits: int) -> pd.DataFrame:
    """A row TOKENS for each range of token hashes that a piece has tokens in, and whether they occur twice in the piece."""
    out = []
    for piece, raw in zip(rows["piece"], rows["tokens"]):
        tokens, many = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
        edges = np.searchsorted(tokens >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))
        out += [(b, piece, tokens[i:j].tobytes(), (many[i:j] > 1).tobytes()) for b, (i, j) in enumerate(zip(edges, edges[1:])) if i < j]
    return pd.DataFrame(out, columns=["bucket", "piece", "tokens", "twice"])


def shared_tokens(rows: pd.DataFrame) -> pd.DataFrame:
    """For every token of a bucket's pieces, as a bit, whether it occurs twice in the corpus."""
    parts = [np.frombuffer(x, np.uint64) for x in rows["tokens"]]
    whole, at, many = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    twice = many > 1
    twice[at[np.concatenate([np.frombuffer(x, np.bool_) for x in rows["twice"]])]] = True
    ends = np.cumsum([len(x) for x in parts])
    shared = twice[at]
    return pd.DataFrame({"piece": rows["piece"], "bucket": rows["bucket"], "n": np.diff(ends, prepend=0).astype(np.int32), "shared": [np.packbits(shared[e - len(x) : e]).tobytes() for e, x in zip(ends, parts)]})


#: kind 0 is a record to deal; kind 1 says that the windows that start in lo..hi of a chunk occur elsewhere too.
RECORDS = "chunk long, at long, right binary, left binary, bound int, done boolean, lo long, hi long, kind int"
OUT = [x.split()[0] for x in RECORDS.split(", ")]


def records(p: pd.Series, shared: pd.DataFrame, width: int) -> pd.DataFrame:
    """RECORDS of a piece's runs whose token others share. Records that are equal within the piece settle each other, and one goes on."""
    mine = shared.sort_values("bucket")
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(mine["shared"], mine["n"])]
    rows, seen = [], {}
    if bits:
        opened = zstandard.ZstdDecompressor()
        number, base, body = int(p["chunk"]), int(p["base"]), opened.decompress(p["body"])
        keep = np.concatenate(bits)[np.unique(np.frombuffer(p["tokens"], np.uint64), return_inverse=True)[1]]
        runs = np.frombuffer(opened.decompress(p["runs"]), np.uint32).reshape(3, -1)[:, keep].astype(np.int64)
        for f, m, a in zip(*runs.tolist()):
            hull = (body[f + a : f + m + width], body[f : f + a][::-1])
            before = seen.get(hull)
            if before is None:
                seen[hull] = row = [number, base + f + a, *hull, 0, False, base + f, base + f + m, 0]
                rows.append(row)
                continue
            if not before[5]:
                before[5] = True
                rows.append([number, 0, None, None, 0, True, before[6], before[7], 1])
            rows.append([number, 0, None, None, 0, True, base + f, base + f + m, 1])
    return pd.DataFrame(rows, columns=OUT, dtype=None if rows else object)


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a row differs from the one before) by rows of words.

    Multikey quicksort: each pass sorts by the next word those rows alone that were equal so far, within their group.
    """
    order = np.argsort(words[:, 0], kind="stable")
    new = np.ones(len(words), bool)
    new[1:] = words[order[1:], 0] != words[order[:-1], 0]
    for depth in range(1, words.shape[1]):
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        rows = order[tied]
        w = words[rows, depth]
        sub = np.lexsort((w, np.cumsum(new[tied])))
        order[tied], w = rows[sub], w[sub]
        new[tied[1:]] |= w[1:] != w[:-1]
    return order, new


def common(a: np.ndarray, b: np.ndarray, step: int = 20_000) -> np.ndarray:
    """How many leading bytes the rows of a and b share."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), step):
        apart = a[i : i + step] != b[i : i + step]
        out[i : i + step] = np.where(apart.any(1), apart.argmax(1), a.shape[1])
    return out


class Bucket:
    """A bucket's records. A window of x bytes before its anchor is one of a record if width - len(right) <= x <= len(left).

    right and left are matrices of bytes, zero beyond the records' lengths; bounds that use them err to too many.
    """

    def __init__(self, rows: pd.DataFrame, width: int):
        self.rows, self.width, self.reach = rows, width, width - GRAM
        self.n_right, self.n_left = (np.fromiter(map(len, rows[c]), np.int64, len(rows)) for c in ("right", "left"))
        self.right = self.padded(rows["right"], width)
        self.left = self.padded(rows["left"], -(-self.reach // 8) * 8)
        self.lowest = np.maximum(width - self.n_right, 0)
        bound = rows["bound"].to_numpy(np.int64)
        self.right_bound, self.left_bound = bound.copy(), np.zeros(len(rows), np.int64)
        #: Found windows as (record, lowest x, highest x); `covered` is where a record has them all.
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.covered = rows["done"].to_numpy(bool).copy()

    @staticmethod
    def padded(column: pd.Series, size: int) -> np.ndarray:
        return np.frombuffer(b"".join([x.ljust(size, b"\0") for x in column]), np.uint8).reshape(-1, size)

    def words(self, *parts: np.ndarray) -> np.ndarray:
        """Columns of words, most significant byte first; 8-bit matrices give one for eight bytes, vectors one."""
        return np.column_stack([np.ascontiguousarray(x).view(">u8").astype(np.uint64) if x.ndim == 2 else x.astype(np.uint64) for x in parts])

    def meet(self, i: np.ndarray, j: np.ndarray, both: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Compare records i with j byte by byte: the windows they share are found; (common bytes right, left), unclipped."""
        r, x = common(self.right[i], self.right[j]), common(self.left[i], self.left[j])
        low = self.width - np.minimum(r, np.minimum(self.n_right[i], self.n_right[j]))
        high = np.minimum(x, np.minimum(self.n_left[i], self.n_left[j]))
        hit = (low <= high) & (i != j)
        for side in (i, j) if both else (i,):
            k = side[hit]
            self.found.append((k, low[hit], high[hit]))
            self.covered[k] |= (low[hit] <= self.lowest[k]) & (high[hit] >= self.n_left[k])
        return r, x

    def by_right(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sort by suffix, then by what stands before: neighbours meet; (order, whether a record's token is new there, whether the record is).

        A record shares most with a neighbour, so that no more than right_bound bytes of a suffix occur elsewhere. All
        may at the ends of the bucket. Each record also meets the commonest one of its token.
        """
        order, new = multikey_order(self.words(self.right, self.n_right, self.left, self.n_left))
        r, _ = self.meet(order[1:], order[:-1])
        most = np.zeros(len(order), np.int64)
        most[1:] = r
        most[:-1] = np.maximum(most[:-1], r)
        most[[0, -1]] = self.width
        self.right_bound[order] = np.maximum(self.right_bound[order], most)
        token = np.ones(len(order), bool)
        token[1:] = r < GRAM
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(order)))
        group = np.cumsum(token)[starts]
        best = np.lexsort((-size, group))
        lead = best[np.append(True, group[best][1:] != group[best][:-1])]
        leader = order[starts[lead]][np.cumsum(token) - 1]
        todo = ~self.covered[order]
        self.meet(order[todo], leader[todo], both=False)
        return order, token, new

    def by_left(self, some: np.ndarray, cut: bool) -> None:
        """Sort `some` by token, then by what stands before the anchor: neighbours meet, and left_bound is found likewise. cut: others of their tokens may lie elsewhere."""
        order, _ = multikey_order(self.words(self.right[some, :GRAM], self.left[some], self.n_left[some], self.right[some, GRAM:], self.n_right[some]))
        order = some[order]
        _, x = self.meet(order[1:], order[:-1])
        same = common(self.right[order[1:], :GRAM], self.right[order[:-1], :GRAM]) == GRAM
        x = np.where(same, x, 0)
        most = np.zeros(len(order), np.int64)
        most[1:] = x
        most[:-1] = np.maximum(most[:-1], x)
        if cut:
            most[[0, -1]] = self.reach
        self.left_bound[order] = np.maximum(self.left_bound[order], most)

    def candidates(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(record, x) of the windows of `some` within their bounds: all that can occur elsewhere."""
        low = np.maximum(self.lowest[some], self.width - self.right_bound[some])
        many = np.maximum(np.minimum(self.n_left[some], self.left_bound[some]) - low + 1, 0)
        return np.repeat(some, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)

    def strings(self, record: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The windows' bytes."""
        out = np.empty((len(record), self.width), np.uint8)
        span = np.arange(self.width)
        for i in range(0, len(record), 50_000):
            k, before = record[i : i + 50_000, None], x[i : i + 50_000, None]
            back = span < before
            out[i : i + 50_000] = np.where(back, self.left[k, np.clip(before - 1 - span, 0, self.left.shape[1] - 1)], self.right[k, np.clip(span - before, 0, self.width - 1)])
        return out

    def single_windows(self, some: np.ndarray, token: np.ndarray, most: int = 100_000) -> None:
        """Sort the candidate windows of `some` (records in order of token), some tokens or one part of a token's x at a time."""
        record, x = self.candidates(some)
        order = np.lexsort((x, token[np.searchsorted(some, record)] if len(some) else record))
        record, x = record[order], x[order]
        key = token[np.searchsorted(some, record)] * (self.width + 1) + x if len(record) else record
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        start = 0
        while start < len(record):
            stop = cuts[np.searchsorted(cuts, start + most, "right") - 1] if start + most < len(record) else len(record)
            if stop <= start:
                nxt = np.searchsorted(cuts, start, "right")
                stop = cuts[nxt] if nxt < len(cuts) else len(record)
            k, at = record[start:stop], x[start:stop]
            place, new = multikey_order(self.words(self.strings(k, at)))
            twin = ~new | np.append(~new[1:], False)
            hit = place[twin]
            self.found.append((k[hit], at[hit], at[hit]))
            start = stop

    def intervals(self) -> pd.DataFrame:
        """RECORDS of kind 1 of all found windows but those of records that were done, overlapping ones of a record as one."""
        parts = [np.concatenate(x) for x in zip(*self.found)] if self.found else [np.zeros(0, np.int64)] * 3
        k, low, high = parts
        keep = ~self.rows["done"].to_numpy(bool)[k]
        k, low, high = k[keep], low[keep], high[keep]
        order = np.lexsort((low, k))
        k, low, high = k[order], low[order], high[order]
        if len(k):
            span = self.width + 2
            top = np.maximum.accumulate(high + k * span)
            begin = np.append(True, (k[1:] != k[:-1]) | (low[1:] + k[1:] * span > top[:-1] + 1))
            starts = np.flatnonzero(begin)
            k, low, high = k[starts], low[starts], (top[np.append(starts[1:], len(top)) - 1] - k[starts] * span)
        at = self.rows["at"].to_numpy(np.int64)[k]
        return pd.DataFrame({"chunk": self.rows["chunk"].to_numpy(np.int64)[k], "at": 0, "right": None, "left": None, "bound": 0, "done": True, "lo": at - high, "hi": at - low, "kind": 1})[OUT]

    def left_open(self, some: np.ndarray) -> pd.DataFrame:
        rows = self.rows.iloc[some]
        return rows.assign(bound=np.minimum(self.right_bound[some], self.width).astype(np.int32), kind=np.int32(0), done=self.covered[some])[OUT]


def settled(rows: pd.DataFrame, width: int, second: bool) -> Iterator[pd.DataFrame]:
    """What a bucket of records finds: intervals, and records of tokens that the bucket's ends may have cut.

    first buckets are ranges of (suffix, before), second ones of (token, before, suffix). Tokens that lie whole in the
    bucket and have windows left to judge are sorted the other way too, and windows still open are sorted singly.
    In a second bucket, cut tokens yield their candidate windows as records whose suffix is the window.
    """
    b = Bucket(rows, width)
    order, token, new = b.by_right()
    number = np.cumsum(token) - 1
    cut = (number == 0) | (number == number[-1])
    needy = np.zeros(number[-1] + 1, bool)
    needy[number[~b.covered[order]]] = True
    needy &= np.bincount(number) > 1
    inner = needy[number] & ~cut & new  # equal records have settled each other, and one stands for them
    some = order[inner]
    if len(some):
        b.by_left(some, False)
        rank = np.empty(len(order), np.int64)
        rank[order] = number
        one = np.sort(some)
        b.single_windows(one, rank[one])
    mine = order[cut & new]
    if second:
        b.by_left(mine, True)
        record, x = b.candidates(np.sort(mine))
        for i in range(0, len(record), 50_000):
            k, before = record[i : i + 50_000], x[i : i + 50_000]
            text = b.strings(k, before)
            place, new = multikey_order(b.words(text))
            twin = ~new | np.append(~new[1:], False)
            b.found.append((k[place[twin]], before[place[twin]], before[place[twin]]))
            at = b.rows["at"].to_numpy(np.int64)[k] - before
            first = place[new]
            again = twin[new]
            yield pd.DataFrame({"chunk": b.rows["chunk"].to_numpy(np.int64)[k][first], "at": at[first], "right": [x.tobytes() for x in text[first]], "left": b"", "bound": 0, "done": again, "lo": at[first], "hi": at[first], "kind": 0})[OUT]
        yield b.intervals()
    else:
        yield b.intervals()
        yield b.left_open(mine)


def equal_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """Intervals of the windows (as records) that occur twice."""
    text = Bucket.padded(rows["right"], len(rows["right"].iloc[0]))
    order, new = multikey_order(np.ascontiguousarray(text).view(">u8").astype(np.uint64))
    hit = order[~new | np.append(~new[1:], False)]
    return rows.iloc[hit].assign(kind=np.int32(1), right=None, left=None, done=True)[OUT]


def dealt(table: DataFrame, keys: list, judge) -> DataFrame:
    """RECORDS that judge(rows) yields for buckets of the table: ranges of the keys, with splitters from a sample."""
    n = table.count()
    buckets = max(1, -(-n // BUCKET_ROWS), min(n // 5_000, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in batches if len(p)]
        if parts:
            yield from judge(pd.concat(parts, ignore_index=True))

    return table.repartitionByRange(buckets, *keys).mapInPandas(run, RECORDS)


def kept_rows(chunk: pd.DataFrame, gone: pd.DataFrame, width: int, keep_text: bool) -> pd.DataFrame:
    """The result's rows of a chunk's documents. gone: lo..hi of windows whose bytes go."""
    chunk = chunk.sort_values("base")
    lengths = np.array(chunk["lengths"].iloc[0], np.int64)
    ends = np.cumsum(lengths)
    order = np.argsort(gone["lo"].to_numpy(np.int64), kind="stable")
    begin, end = gone["lo"].to_numpy(np.int64)[order], gone["hi"].to_numpy(np.int64)[order] + width
    if len(begin):
        doc = np.searchsorted(ends, begin, "right")
        top = np.maximum.accumulate(end)
        new = np.append(True, (begin[1:] > top[:-1]) | (doc[1:] != doc[:-1]))
        starts = np.flatnonzero(new)
        begin, end, doc = begin[starts], top[np.append(starts[1:], len(top)) - 1], doc[starts]
        spans, removed = np.bincount(doc, minlength=len(ends)), np.bincount(doc, end - begin, len(ends)).astype(np.int64)
    else:
        spans = removed = np.zeros(len(ends), np.int64)
    hashes, texts = [hashlib.sha256() for _ in ends], [[] for _ in ends]
    for _, p in chunk.iterrows():
        base, own = int(p["base"]), int(p["own"])
        body = np.frombuffer(zstandard.ZstdDecompressor().decompress(p["body"]), np.uint8)[:own]
        step = np.zeros(own + 1, np.int64)
        here = (begin < base + own) & (end > base)
        np.add.at(step, np.maximum(begin[here] - base, 0), 1)
        np.add.at(step, np.minimum(end[here] - base, own), -1)
        stays = np.cumsum(step)[:own] == 0
        left, at = body[stays].tobytes(), np.concatenate([[0], np.cumsum(stays)])
        edges = [(0, 0, own)] if len(chunk) > 1 else [(d, int(e - n), int(e)) for d, (e, n) in enumerate(zip(ends, lengths))]
        for d, i, j in edges:
            kept = left[at[i] : at[j]]
            hashes[d].update(kept)
            if keep_text:
                texts[d].append(kept)
    out = {"doc_id": pd.array([None if pd.isna(x) else int(x) for x in chunk["doc_ids"].iloc[0]], "Int64"), "n_bytes": lengths, "n_removed": removed, "n_spans": spans, "kept_sha256": [h.hexdigest() for h in hashes]}
    return pd.DataFrame(out | ({"kept": [b"".join(x) for x in texts]} if keep_text else {}))


def suffix_dedup(docs: DataFrame, width: int = 200, text: str = "text", key: str = "doc_id", part: int = PART, keep_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (its bytes) if keep_text.

    A byte goes if a string of `width` bytes (a multiple of 8) that covers it also starts anywhere else, in this or
    another document. Strings are judged on the input and compared byte by byte. Null text is empty. Rows with null or
    repeated doc_id are documents like others. Documents travel in compressed chunks, written once in a bucketed table, so
    that answers come to the chunks and chunks stay; a document longer than `part` bytes is several rows there and never
    whole in memory but as compressed bytes. A passage that a third of all documents share is one record a chunk, and
    any number of records of one token is spread over buckets. An empty table gives an empty result; other columns are
    not read.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    bits = max(6, (size // BUCKET_BYTES).bit_length())
    name = f"chunks_{uuid.uuid4().hex}"
    paths = [f"{shared_folder(spark)}/{name}"]
    try:
        chunked(docs, width, text, key, part).write.bucketBy(buckets, "piece").format("parquet").option("compression", "none").option("path", paths[0]).saveAsTable(name)
        chunks = spark.table(name)

        def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield token_rows(rows, bits)

        def emit(piece: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
            return records(piece.iloc[0], shared, width)

        empty = pd.DataFrame({c: pd.Series([], dtype=object) for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []))})

        def finish(chunk: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
            return kept_rows(chunk, gone, width, keep_text) if len(chunk) else empty

        shared, path = stored(chunks.select("piece", "tokens").mapInPandas(asked, TOKENS).groupBy("bucket").applyInPandas(shared_tokens, SHARED), "suffix-tokens")
        paths.append(path)
        body = chunks.select("piece", "chunk", "base", "body", "runs", "tokens")
        rows, path = stored(body.groupBy("piece").cogroup(shared.groupBy("piece")).applyInPandas(emit, RECORDS), "suffix-records", "kind")
        paths.append(path)
        salt = F.xxhash64("chunk", "at")
        with setting(spark, "spark.sql.execution.rangeExchange.sampleSizePerPartition", str(SAMPLES)):
            one, path = stored(dealt(rows.where("kind = 0"), ["right", "left", salt], lambda p: settled(p, width, False)), "suffix-settled", "kind")
            paths.append(path)
            two, path = stored(dealt(one.where("kind = 0"), [F.substring("right", 1, GRAM), "left", "right", salt], lambda p: settled(p, width, True)), "suffix-cut", "kind")
            paths.append(path)
            three, path = stored(dealt(two.where("kind = 0"), ["right"], lambda p: iter([equal_windows(p)])), "suffix-windows", "kind")
            paths.append(path)
        found = rows.where("kind = 1").select("chunk", "lo", "hi")
        for more in (one, two, three):
            found = found.unionByName(more.where("kind = 1").select("chunk", "lo", "hi"))
        schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
        whole = chunks.select("piece", "chunk", "parts", "base", "own", "doc_ids", "lengths", "body")
        single = whole.where("parts = 1").groupBy("piece").cogroup(found.withColumnRenamed("chunk", "piece").groupBy("piece")).applyInPandas(finish, schema)
        long = whole.where("parts > 1")
        cut = long.groupBy("chunk").cogroup(found.join(long.select("chunk").distinct(), "chunk", "left_semi").groupBy("chunk")).applyInPandas(finish, schema)
        return stored(single.unionByName(cut), "suffix-kept")[0]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        forget(spark, *paths)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that strings of 200 repeat; suffix_dedup states every case."""
    return suffix_dedup(documents(spark, sf_dir))
