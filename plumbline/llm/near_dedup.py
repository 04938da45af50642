"""Near-duplicate documents by BagMinHash signatures of word shingles, banding and verified multiset overlap."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chars import mixed, slabs
from .components import components, connected
from .work import claim, documents, forget, keyed_texts, ship, stored, sweep

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
POSITIONS = BANDS * ROWS
#: Texts signed at a time; each takes some thousand points, however short it is.
SLAB_TEXTS = 300
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Large buckets whose names are sent to every task; more are joined as Spark decides.
BROADCAST_BANDS = 100_000
#: Odd multipliers of a shingle's places.
FACTORS = [np.uint64(int(GOLD) ** (2 * k + 1) % 2**64) for k in range(64)]


class WordHashes(dict):
    """Blank-delimited token -> the 64-bit hashes of its words, as bytes, made once while it is kept.

    Words are runs of letters and digits in lower case, so a token may hold none or several.
    """

    KEPT, LONGEST, WORD = 250_000, 40, re.compile(r"[^\W_]+")

    def __missing__(self, token: str) -> bytes:
        out = b"".join([xxhash.xxh64_digest(w.encode("utf-8", "surrogatepass"))[::-1] for w in self.WORD.findall(token.lower())])
        if len(token) <= self.LONGEST:
            if len(self) >= self.KEPT:
                self.clear()
            self[token] = out
        return out


WORD_HASHES = WordHashes()


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes on end, how many each text has) of runs of `words` words, repeats included.

    A text of fewer words, but some, is one shingle.
    """
    get = WORD_HASHES.__getitem__
    found = [b"".join(map(get, t.split())) for t in texts]
    many = np.fromiter((len(x) // 8 for x in found), np.int64, len(found))
    word = np.frombuffer(b"".join(found), "<u8")
    if not len(word):
        return np.zeros(0, np.uint64), many
    within = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
    total = np.repeat(many, many)
    last = np.where(total < words, (within == 0) * total, np.where(within + words <= total, words, 0))
    full = np.zeros(len(word), np.uint64)
    for k in range(words):
        part = word[k:] * FACTORS[k]
        full[: len(word) - k] += part if k == 0 else part * (last[: len(word) - k] > k)
    keep = last > 0
    return mixed(full[keep] + last[keep].astype(np.uint64)), np.where(many < words, np.minimum(many, 1), np.maximum(many - words + 1, 0))


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct shingles, sorted, and how often they occur."""
    hashes, many = shingles(texts)
    ends = np.cumsum(many)
    return [np.unique(hashes[e - n : e], return_counts=True) for e, n in zip(ends, many)]


def bag_id(bag: tuple[np.ndarray, np.ndarray]) -> bytes:
    """16 bytes that equal bags share."""
    h, n = bag
    n = n.astype(np.uint64)
    one = mixed(h ^ mixed(n)).sum(dtype=np.uint64)
    two = mixed(h * GOLD + mixed(n + GOLD)).sum(dtype=np.uint64)
    return np.array([one, two], "<u8").tobytes()


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(all_bags: list[tuple[np.ndarray, np.ndarray]], positions: int = POSITIONS) -> np.ndarray:
    """BagMinHash: a row of `positions` 64-bit values a bag; the share of equal places estimates the weighted Jaccard similarity.

    Weights are discretised at whole numbers, and the levels up to a weight are covered by dyadic blocks (0, 1],
    (1, 2], (2, 4], ... Each (shingle, block) has a Poisson process as fast as the block is wide, seeded by the two
    alone; its points carry a position and a level, and count if the level is within the weight. So a shingle that
    occurs n times costs log n processes, and bags agree on all points that both weights cover. A position's value
    names its earliest point. Points are drawn up to a time by which all positions are likely taken; bags of which some
    are not are drawn on to twice the time. An empty bag has zeros.
    """
    out = np.zeros((len(all_bags), positions), np.uint64)
    todo = np.array([n for n, (h, _) in enumerate(all_bags) if len(h)], np.int64)
    factor = np.log(positions) + 4
    while len(todo):
        sizes = [len(all_bags[n][0]) for n in todo]
        owner = np.repeat(np.arange(len(todo)), sizes)
        hashes = np.concatenate([all_bags[n][0] for n in todo])
        weight = np.concatenate([all_bags[n][1] for n in todo])
        limit = positions * factor / np.bincount(owner, weight)
        block = np.ceil(np.log2(weight)).astype(np.int64)
        of = np.repeat(np.arange(len(hashes)), block + 1)
        height = np.arange(len(of)) - np.repeat(np.cumsum(block + 1) - block - 1, block + 1)
        low = np.where(height > 0, 2.0 ** (height - 1), 0)
        wide = np.where(height > 0, low, 1)
        seed = mixed(hashes[of] + (height.astype(np.uint64) + np.uint64(1)) * GOLD)
        top, place, t = weight[of], owner[of], np.zeros(len(of))
        found_t, found_at, found_id = [], [], []
        drawn, k = 0, 2
        while len(seed):
            step = np.arange(drawn + 1, drawn + k + 1, dtype=np.uint64) * np.uint64(2) * GOLD
            h = mixed(seed[:, None] + step)
            times = t[:, None] - np.cumsum(np.log(_uniform(h)), axis=1) / wide[:, None]
            on = times <= limit[place][:, None]
            row = np.repeat(np.arange(len(seed)), k)[on.ravel()]
            points, ids = times[on], h[on]
            g = mixed(ids + GOLD)
            at = place[row] * positions + (_uniform(g) * positions).astype(np.int64)
            high = np.flatnonzero(low[row])
            beyond = high[low[row[high]] + np.floor(_uniform(mixed(g[high])) * wide[row[high]]) + 1 > top[row[high]]]
            counts = np.ones(len(row), bool)
            counts[beyond] = False
            found_t.append(points[counts])
            found_at.append(at[counts])
            found_id.append(ids[counts])
            more = on[:, -1]
            seed, top, place, low, wide, t = seed[more], top[more], place[more], low[more], wide[more], times[more, -1]
            drawn, k = drawn + k, min(2 * k, 64)
        t, at, ids = np.concatenate(found_t), np.concatenate(found_at), np.concatenate(found_id)
        first = np.full(len(todo) * positions, np.inf)
        np.minimum.at(first, at, t)
        won = t == first[at]
        sig = np.zeros(len(todo) * positions, np.uint64)
        sig[at[won]] = ids[won]
        full = np.isfinite(first).reshape(-1, positions).all(1)
        out[todo[full]] = sig.reshape(-1, positions)[full]
        todo, factor = todo[~full], factor * 2
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of `rows` places of a signature."""
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for r in range(rows):
        keys = mixed(keys + parts[:, :, r] + GOLD)
    return mixed(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)


def similarities(some: list[tuple[np.ndarray, np.ndarray]], width: int = 8192) -> np.ndarray:
    """The weighted Jaccard similarity of every two bags.

    A shingle that occurs n times is n features, so that shared features count the multisets' overlap; features of one
    bag only are left out, the others multiplied in slices of `width`.
    """
    n = len(some)
    total = np.array([w.sum() for _, w in some], np.float64)
    owner = np.repeat(np.arange(n), total.astype(np.int64))
    hashes = np.concatenate([np.repeat(h, w) for h, w in some])
    level = np.concatenate([np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) for _, w in some])
    _, feature, many = np.unique(hashes + level.astype(np.uint64) * GOLD, return_inverse=True, return_counts=True)
    shared = many[feature] > 1
    feature, owner = feature[shared], owner[shared]
    _, feature = np.unique(feature, return_inverse=True)
    order = np.argsort(feature, kind="stable")
    feature, owner = feature[order], owner[order]
    both = np.zeros((n, n), np.float32)
    for low in range(0, int(feature[-1]) + 1 if len(feature) else 0, width):
        i, j = np.searchsorted(feature, (low, low + width))
        x = np.zeros((n, width), np.float32)
        x[owner[i:j], feature[i:j] - low] = 1
        both += x @ x.T
    return both / np.maximum(total[:, None] + total[None, :] - both, 1)


def agreement(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many places each sketch of one equals each of two."""
    out = np.zeros((len(one), len(two)), np.uint8)
    for k in range(one.shape[1]):
        out += one[:, k, None] == two[None, :, k]
    return out


def sketch_matrix(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, POSITIONS)


def signed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, text_id, bag, bands, sketch) of every row; the last three are null for texts without a word.

    A sketch is the lowest byte of each place of a signature.
    """
    ship(docs.sparkSession)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("near", WORD_HASHES.clear)
        for batch in batches:
            texts, ids = [x or "" for x in batch["text"]], pd.arrays.IntegerArray(batch["doc_id"].to_numpy(np.int64), batch["no_id"].to_numpy(bool))
            for start, part in slabs(texts, 1_000_000, SLAB_TEXTS):
                got = bags(part)
                sig = signatures(got)
                keys, low = band_keys(sig), sig.astype(np.uint8)
                some = [len(h) > 0 for h, _ in got]
                rows = slice(start, start + len(part))
                yield pd.DataFrame({
                    "doc_id": ids[rows], "text_id": batch["text_id"].to_numpy()[rows],
                    "bag": [bag_id(g) if s else None for g, s in zip(got, some)],
                    "bands": [k if s else None for k, s in zip(keys, some)],
                    "sketch": [x.tobytes() if s else None for x, s in zip(low, some)],
                })

    return keyed_texts(docs, text, key).withColumn("text_id", F.xxhash64("text")).mapInPandas(sign, "doc_id long, text_id long, bag binary, bands array<long>, sketch binary")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, part: int) -> DataFrame:
    """The pairs (a, b) of bags whose multisets of shingles are as similar as threshold. texts: (bag, text), a row a bag.

    Pairs meet at a; one of a's groups of about `part` partners is a task's unit, and has a's text once. So every
    text moves once for each pair and once for each group, however many partners a bag has.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("groups"))
    dealt = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("group"))
    centres = groups.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    rows = texts.withColumnRenamed("bag", "b").join(dealt.unionByName(centres), "b")

    def check(p: pd.DataFrame) -> pd.DataFrame:
        claim("near", WORD_HASHES.clear)
        mine = p["b"].map(bytes) == bytes(p["a"].iloc[0])
        if not mine.any():
            return p.iloc[:0][["a", "b"]]
        (h, n), total = bags([p["text"][mine].iloc[0]])[0], 0
        total = n.sum()
        others, keep = p[~mine], []
        for _, some in slabs(others["text"].tolist(), 1_000_000):
            for g, m in bags(some):
                at = np.minimum(np.searchsorted(h, g), len(h) - 1)
                both = np.minimum(m, np.where(h[at] == g, n[at], 0)).sum()
                keep.append(both >= (threshold - 1e-7) * (total + m.sum() - both))
        return others[np.array(keep, bool)][["a", "b"]]

    return rows.groupBy("a", "group").applyInPandas(check, "a binary, b binary")


def pairs_near(p: pd.DataFrame, least: int, rows: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first, second, places that agree) of all pairs of rows of one band (of p, in order of bands) and of different classes that agree in `least` places."""
    band, code = p["band"].to_numpy(), pd.factorize(p["class"].map(bytes))[0]
    sketch, ahead = sketch_matrix(p["sketch"]), 1
    at = np.arange(len(p))
    while True:
        at = at[at + ahead < len(p)]
        at = at[band[at] == band[at + ahead]]
        if not len(at):
            return
        other = at[code[at] != code[at + ahead]]
        for i in range(0, len(other), rows):
            one, two = other[i : i + rows], other[i : i + rows] + ahead
            same = (sketch[one] == sketch[two]).sum(1)
            hit = same >= least
            yield one[hit], two[hit], same[hit]
        ahead += 1


def block_pairs_near(one: pd.DataFrame, two: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of two blocks of one band."""
    same = agreement(sketch_matrix(one["sketch"]), sketch_matrix(two["sketch"]))
    code = pd.factorize(pd.concat([one["class"], two["class"]]).map(bytes))[0]
    a, b = np.nonzero((same >= least) & (code[: len(one), None] != code[None, len(one) :]))
    return a, b, same[a, b]


def unmet_pairs(members: DataFrame, least: int, block: int, best: int | None) -> DataFrame:
    """Pairs (a < b) of bags of one bucket and of different classes whose sketches agree in `least` places or more.

    best: of every bag the `best` nearest; None: so few that they connect the same bags as all such pairs do.
    members: (band, bag, sketch, class) of the buckets with several classes. Buckets of up to `block` members share
    tasks; larger ones form blocks, which meet two at a time. Only sketches travel, and never a pair for every two.
    """
    spark = members.sparkSession
    sizes = members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), members.count() // 20_000)
    large, large_path = stored(sizes.where("blocks > 1"), "large-buckets")
    large = F.broadcast(large) if large.count() <= BROADCAST_BANDS else large
    few = members.join(large, "band", "left_anti").withColumn("task", F.pmod(F.xxhash64("band", F.lit(5)), F.lit(tasks)))
    placed = members.join(large, "band").withColumn("mine", F.pmod(F.xxhash64("bag"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = placed.select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "bag", "sketch", "class")

    def named(bag: np.ndarray, x: np.ndarray, y: np.ndarray, same: np.ndarray) -> pd.DataFrame:
        """Bags x and y (places in bag, in their order) as pairs."""
        if best is None:
            root = connected(len(bag), x, y)
            x, y = np.flatnonzero(root != np.arange(len(bag))), root[root != np.arange(len(bag))]
            return pd.DataFrame({"a": bag[y], "b": bag[x], "same": 0})
        out = pd.DataFrame({"x": np.minimum(x, y), "y": np.maximum(x, y), "same": same.astype(np.int32)}).drop_duplicates(["x", "y"])
        ends = pd.concat([out.assign(end=out["x"]), out.assign(end=out["y"])]).sort_values("same", ascending=False, kind="stable")
        out = ends.groupby("end").head(best).drop_duplicates(["x", "y"])
        return pd.DataFrame({"a": bag[out["x"]], "b": bag[out["y"]], "same": out["same"]})

    def meet_few(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("band", ignore_index=True)
        bag, at = np.unique(p["bag"].map(bytes).to_numpy(), return_inverse=True)
        found = list(pairs_near(p, least)) or [(np.zeros(0, int),) * 3]
        x, y, same = (np.concatenate(c) for c in zip(*found))
        return named(bag, at[x], at[y], same)

    def meet_blocks(p: pd.DataFrame) -> pd.DataFrame:
        left = p["mine"] == p["i"]
        one = p[left]
        two = p[~left] if p["i"].iloc[0] != p["j"].iloc[0] else one
        x, y, same = block_pairs_near(one, two, least)
        names = np.concatenate([one["bag"].map(bytes).to_numpy(), two["bag"].map(bytes).to_numpy()])
        bag, at = np.unique(names, return_inverse=True)
        return named(bag, at[x], at[len(one) + y], same)

    pairs = few.groupBy("task").applyInPandas(meet_few, "a binary, b binary, same int")
    pairs = pairs.unionByName(many.repartition("band", "i", "j").groupBy("band", "i", "j").applyInPandas(meet_blocks, "a binary, b binary, same int"))
    if best is not None:
        ends = pairs.distinct().select("a", "b", "same", F.explode(F.array("a", "b")).alias("end"))
        pairs = ends.withColumn("_r", F.row_number().over(Window.partitionBy("end").orderBy(F.desc("same"), "a", "b"))).where(F.col("_r") <= best)
    out = stored(pairs.select("a", "b").distinct(), "unmet-pairs")[0]
    forget(spark, large_path)
    return out


def family_links(p: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links (a, b) that connect the texts of one or two blocks as all pairs of threshold or more do; a is a root."""
    claim("near", WORD_HASHES.clear)
    order = np.argsort(p["bag"].map(bytes).to_numpy())
    names = p["bag"].map(bytes).to_numpy()[order]
    near = similarities(bags(p["text"].iloc[order].tolist())) >= threshold - 1e-7
    x, y = np.nonzero(np.triu(near, 1))
    root = connected(len(names), x, y)
    other = np.flatnonzero(root != np.arange(len(names)))
    return pd.DataFrame({"a": names[root[other]], "b": names[other]})


def met_families(pairs: DataFrame, texts: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links of all bags that pairs (a, b) connect, every two of a family verified on their whole multisets.

    A family's texts form blocks of `block`, which meet two at a time; a meeting returns a root a text, never pairs.
    """
    grown = components(pairs)
    family, _ = stored(grown.unionByName(grown.select(F.col("component").alias("node"), "component").distinct()), "families")
    sizes = family.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = family.join(sizes, "component").select(F.col("node").alias("bag"), F.col("component").alias("family"), "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("mine"))
    spread = texts.join(placed, "bag").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = spread.select("family", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "bag", "text")
    return tasks.repartition("family", "i", "j").groupBy("family", "i", "j").applyInPandas(lambda p: family_links(p, threshold), "a binary, b binary")


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, block: int = 1024, part: int = 128, best: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, class_id, kept, text_id (the text's 64-bit hash).

    Classes are the connected components of links between texts whose bags of five-word shingles have a weighted
    Jaccard similarity of threshold or more; class_id is a class's smallest doc_id, whose row is kept. Texts with equal
    bags become one before any pair is made. Signatures' bands put bags in buckets. First every bag of a bucket is
    verified against the bucket's least bag, which joins most of what belongs together. In buckets that still hold several
    classes, members of different classes are compared by sketch: every bag is verified with the `best` that agree with it
    most, and classes grow; then what still agrees like texts of the threshold (five deviations below it at most) without
    being one class forms families, in which every two texts are verified, in blocks of 4 * part. So the classes are those
    that all bucket pairs, verified on their whole multisets, would give; nothing is capped. With 25 bands of 5, a pair
    at 0.8 shares no bucket once in 20,000 times.
    Null texts and those without a letter or digit are classes of their own, as are rows with a null doc_id (class_id
    null). Rows that repeat a doc_id with other texts are classed by their own text; of those in one class whose id is its
    least, the text of least bag is kept. Rows that repeat both are marked alike. Texts of any length are signed and
    verified whole. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    sigs, _ = stored(signed(docs, text, key), "signatures")
    bagged = sigs.where("doc_id is not null and bag is not null")
    reps, _ = stored(bagged.groupBy("bag").agg(F.min(F.struct("doc_id", "text_id")).alias("x"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).select("bag", F.col("x.doc_id").alias("rep"), "x.text_id", "bands", "sketch"), "bags")
    entries = reps.select("bag", F.explode("bands").alias("band"))
    leaders = entries.groupBy("band").agg(F.min("bag").alias("leader"), F.max("bag").alias("last")).where("leader < last").select("band", "leader")
    shared, shared_path = stored(entries.join(leaders, "band"), "buckets")
    sweep(spark)
    least = max(int(POSITIONS * threshold - 5 * math.sqrt(POSITIONS * threshold * (1 - threshold))), 1)
    sketches = reps.select("bag", "sketch")

    @F.pandas_udf("boolean")
    def alike(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series((sketch_matrix(one) == sketch_matrix(two)).sum(1) >= least)

    near = shared.where("bag > leader").select(F.col("leader").alias("a"), F.col("bag").alias("b")).distinct()
    near = near.join(sketches.toDF("a", "_one"), "a").join(sketches.toDF("b", "_two"), "b")
    tried, tried_path = stored(near.where(alike("_one", "_two")).select("a", "b"), "tried-pairs")
    sweep(spark)
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rep"), F.xxhash64(text).alias("text_id"), F.col(text).alias("text"))

    def texts(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.explode(F.array("a", "b")).alias("bag")).distinct()
        return own.join(reps.join(needed, "bag", "left_semi").select("bag", "rep", "text_id"), ["rep", "text_id"]).groupBy("bag").agg(F.first("text").alias("text"))

    links, links_path = stored(verified(tried, texts(tried), threshold, part), "near-links")
    sweep(spark)
    found, found_path = stored(components(links), "near-classes")
    old = [shared_path, tried_path, links_path]
    for most in (best, None):
        classed = shared.join(found.withColumnRenamed("node", "bag"), "bag", "left").select("band", "bag", F.coalesce("component", "bag").alias("class"))
        mixed_bands = classed.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("band")
        members, members_path = stored(classed.join(mixed_bands, "band", "left_semi").join(sketches, "bag").select("band", "bag", "sketch", "class"), "mixed-buckets")
        fresh = unmet_pairs(members, least, block, most)
        old.append(members_path)
        sweep(spark)
        if fresh.isEmpty():
            break
        checked = verified(fresh.join(tried, ["a", "b"], "left_anti"), texts(fresh), threshold, part) if most else met_families(fresh, texts(fresh), threshold, 4 * part)
        more, more_path = stored(checked, "near-links")
        old += [more_path, found_path]
        sweep(spark)
        found, found_path = stored(components(found.toDF("a", "b").unionByName(more)), "near-classes")
    forget(spark, *old)
    sweep(spark)
    grouped = reps.join(found.withColumnRenamed("node", "bag"), "bag", "left").select("bag", F.coalesce("component", "bag").alias("class"), "rep")
    first = grouped.groupBy("class").agg(F.min(F.struct("rep", "bag")).alias("first"))
    classes = grouped.join(first, "class").select("bag", F.col("first.rep").alias("least_id"), F.col("first.bag").alias("least_bag"))
    out = sigs.select("doc_id", "text_id", "bag").join(classes, "bag", "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("least_id", "doc_id"))
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == mine) & F.coalesce(F.col("bag") == F.col("least_bag"), F.lit(True))
    return out.select("doc_id", mine.alias("class_id"), kept.alias("kept"), "text_id")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents; near_dedup states every case."""
    return near_dedup(documents(spark, sf_dir)).drop("text_id")
