"""Embedding near-dedup: exact cosine links by dual traversal of cover trees."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, connected
from .work import ship, stored

#: Covering radii of the levels below a block's root, in chord length of unit vectors; the last level is the vectors.
RADII = (0.5, 0.25, 0.125, 0.0625)
#: Slack of bounds on distances, above the rounding of 64-bit and of 32-bit products.
SLACK, SLACK32 = 1e-9, 1e-4
MOST_PIVOTS = 4096
#: Blocks of a tile: tiles meet two at a time, so that a block's tree moves once for each tile and not for each block.
TILE = 16


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


class CoverTree:
    """Nested levels of centres over a block of unit vectors; a level's nodes lie in one node of the level above.

    Of each level: centre (a vector's index), radius (to the farthest vector of the node), size, parent, and the node
    of every vector. A node's centre is also a centre of the level below.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self._unit = ids, vectors, None
        x = unit(vectors)
        gram = x @ x.T
        self.levels = [self._level(gram, np.zeros(1, np.int64), np.zeros(len(x), np.int64), np.zeros(1, np.int64))]
        for radius in (*RADII, 0.0):
            above = self.levels[-1]
            centres, node = self._cover(gram, above["node"], above["centre"], radius)
            self.levels.append(self._level(gram, centres, node, above["node"][centres]))

    def unit(self) -> np.ndarray:
        """The unit vectors, made once where the tree is used; they do not travel."""
        if self._unit is None:
            self._unit = unit(self.vectors)
        return self._unit

    @staticmethod
    def _cover(gram: np.ndarray, parent: np.ndarray, first: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        n = len(gram)
        if radius == 0:
            return np.arange(n), np.arange(n)
        near = gram >= 1 - radius * radius / 2
        node, centres = np.full(n, -1), []
        for i in [*first, *range(n)]:
            if node[i] < 0:
                node[near[i] & (node < 0) & (parent == parent[i])] = len(centres)
                node[i] = len(centres)
                centres.append(i)
        return np.array(centres), node

    @staticmethod
    def _level(gram: np.ndarray, centre: np.ndarray, node: np.ndarray, parent: np.ndarray) -> dict:
        radius = np.zeros(len(centre))
        own = centre[node]
        np.maximum.at(radius, node, np.where(own == np.arange(len(node)), 0, chord(gram[np.arange(len(node)), own])))
        order = np.argsort(parent, kind="stable")
        places = {"centre": centre, "size": np.bincount(node, minlength=len(centre)), "node": node, "children": order, "child_start": np.searchsorted(parent[order], np.arange(parent.max() + 2))}
        return {"radius": radius} | {k: v.astype(np.int32) for k, v in places.items()}


def _expanded(level_a: dict, level_b: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children, in the given lower levels, of the node pairs (a, b)."""
    sa, sb = level_a["child_start"], level_b["child_start"]
    na, nb = (sa[a + 1] - sa[a]).astype(np.int64), (sb[b + 1] - sb[b]).astype(np.int64)
    many = na * nb
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    width = np.repeat(nb, many)
    return level_a["children"][np.repeat(sa[a], many) + within // width], level_b["children"][np.repeat(sb[b], many) + within % width]


NO_LINKS = pd.DataFrame({"vec_id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})


def dual_links(one: CoverTree, two: CoverTree | None, threshold: float) -> pd.DataFrame:
    """vec_id, links, root of every vector that links in one (two None) or between one and two.

    A node pair is dropped if no two of its vectors can be within reach, and taken whole if all are; else the pairs of
    its children follow. links counts partners; root is the smallest identifier that this block pair connects it with.
    """
    same = two is None
    two = one if same else two
    reach = math.sqrt(2 - 2 * threshold)
    xa, xb = one.unit(), two.unit()
    na = len(xa)
    shift = 0 if same else na
    count = np.zeros(na if same else na + len(xb), np.int64)
    edges_a, edges_b = [], []
    a = b = np.zeros(1, np.int64)
    for depth, (la, lb) in enumerate(zip(one.levels, two.levels)):
        if depth:
            if depth == 1:  # below the roots all centres meet in one product
                s = xa[la["centre"]].astype(np.float32) @ xb[lb["centre"]].astype(np.float32).T
                bound = 1 - (reach + la["radius"] + lb["radius"].max()) ** 2 / 2 - SLACK32
                a, b = np.nonzero(s >= np.where(reach + la["radius"] + lb["radius"].max() >= 2, -2, bound)[:, None])
                once = np.ones(len(a), bool) if not same else a <= b
            else:
                own = np.repeat(a == b, (la["child_start"][a + 1] - la["child_start"][a]) * (lb["child_start"][b + 1] - lb["child_start"][b])) & same
                a, b = _expanded(la, lb, a, b)
                once = ~own | (a <= b)
            a, b = a[once], b[once]
        ca, cb, ra, rb = la["centre"][a], lb["centre"][b], la["radius"][a], lb["radius"][b]
        cosine = np.empty(len(a))
        for i in range(0, len(a), 100_000):
            cosine[i : i + 100_000] = np.einsum("ij,ij->i", xa[ca[i : i + 100_000]], xb[cb[i : i + 100_000]])
        d = np.where((ca == cb) & same, 0, chord(cosine))
        single = (ra == 0) & (rb == 0)
        self_pair = (a == b) & same
        taken = np.where(single, cosine >= threshold, d + ra + rb <= reach - SLACK)
        taken |= self_pair & (2 * ra <= reach - SLACK)
        dropped = np.where(single, ~taken, d - ra - rb > reach + SLACK)
        for apart, pick in ((True, taken & ~self_pair), (False, taken & self_pair)):
            ta, tb = a[pick], b[pick]
            if not len(ta):
                continue
            size_a, size_b = la["size"], lb["size"]
            by_a = np.bincount(ta, size_b[tb] - (0 if apart else 1), len(size_a)).astype(np.int64)
            count[:na] += by_a[la["node"]]
            if apart:
                by_b = np.bincount(tb, size_a[ta], len(size_b)).astype(np.int64)
                count[shift : shift + len(xb)] += by_b[lb["node"]]
                edges_a.append(la["centre"][ta])
                edges_b.append(lb["centre"][tb] + shift)
                on_b = np.zeros(len(size_b), bool)
                on_b[tb] = True
                p = np.flatnonzero(on_b[lb["node"]])
                edges_a.append(p + shift)
                edges_b.append(lb["centre"][lb["node"][p]] + shift)
            on_a = np.zeros(len(size_a), bool)
            on_a[ta] = True
            p = np.flatnonzero(on_a[la["node"]])
            edges_a.append(p)
            edges_b.append(la["centre"][la["node"][p]])
        rest = ~taken & ~dropped
        a, b = a[rest], b[rest]
        if not len(a):
            break
    if not edges_a:
        return NO_LINKS
    label = connected(len(count), np.concatenate(edges_a), np.concatenate(edges_b))
    ids = one.ids if same else np.concatenate([one.ids, two.ids])
    root = np.full(len(count), np.iinfo(np.int64).max)
    np.minimum.at(root, label, ids)
    some = count > 0
    return pd.DataFrame({"vec_id": ids[some], "links": count[some], "root": root[label][some]})


def farthest_first(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` vectors, each the farthest of the sample from those before: the net of every radius is a prefix."""
    if not len(sample):
        return sample
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < most and nearest.min() < 1 - 1e-6:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def _links_of(vectors: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """vec_id, links, root rows (several a vector) of the n vectors (vec_id, x) of one dimension."""
    spark = vectors.sparkSession
    rows = min(block, max(256, n // 24))
    pivots = max(1, min(MOST_PIVOTS, n // rows))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(n, 4 * pivots)).toPandas()
    net = farthest_first(unit(np.array(sample["x"].tolist())), pivots)
    sent = spark.sparkContext.broadcast(net)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                s = unit(np.array(p["x"].tolist())) @ sent.value.T
                yield p.assign(cell=s.argmax(1), far=chord(s.max(1)))

    cells, _ = stored(vectors.mapInPandas(assign, T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])), "vector-cells")
    stats = sorted(cells.groupBy("cell").agg(F.count(F.lit(1)), F.max("far")).collect())
    parts = [-(-r[1] // rows) for r in stats]
    first = np.cumsum([0, *parts])
    place = {r[0]: n for n, r in enumerate(stats)}
    centre = net[list(place)]
    gap, far = chord(centre @ centre.T), np.array([r[2] for r in stats])
    meet = gap <= far[:, None] + far[None, :] + math.sqrt(2 - 2 * threshold) + 1e-6
    spans = []
    tile = max(1, min(TILE, int(first[-1]) // 8))
    for cell, n in place.items():
        for m in np.flatnonzero(meet[n]):
            low, high = int(first[m]) // tile, (int(first[m + 1]) - 1) // tile
            if spans and spans[-1][0] == cell and low <= spans[-1][2] + 1:
                spans[-1][2] = max(high, spans[-1][2])
            else:
                spans.append([cell, low, high])
    dims = spark.createDataFrame([(c, int(first[n]), parts[n]) for c, n in place.items()], "cell int, base int, parts int")
    meets = spark.createDataFrame(spans, "cell int, lo int, hi int")
    blocked = cells.join(dims, "cell").withColumn("block", F.col("base") + F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("parts")).cast("int"))

    def build(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("vec_id")
        tree = CoverTree(p["vec_id"].to_numpy(np.int64), np.array(p["x"].tolist()))
        return pd.DataFrame({"block": p["block"].iloc[:1].to_numpy(), "cell": p["cell"].iloc[:1].to_numpy(), "tree": [pickle.dumps(tree)]})

    trees, _ = stored(blocked.select("block", "cell", "vec_id", "x").groupBy("block").applyInPandas(build, "block int, cell int, tree binary"), "cover-trees")
    own = F.floor(F.col("block") / tile).cast("int")
    sides = trees.join(meets, "cell").select("block", "tree", own.alias("own"), F.explode(F.sequence("lo", "hi")).alias("other"))
    tasks = sides.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "block", "tree")

    def meet_tiles(p: pd.DataFrame) -> pd.DataFrame:
        i, j = p["i"].iloc[0], p["j"].iloc[0]
        held = [(own, block, pickle.loads(t)) for own, block, t in sorted(zip(p["own"], p["block"], p["tree"]), key=lambda x: x[1])]
        found = []
        for n, (own, _, one) in enumerate(held):
            if i == j:
                found += [dual_links(one, None, threshold)] + [dual_links(one, two, threshold) for _, _, two in held[n + 1 :]]
            elif own == i:
                found += [dual_links(one, two, threshold) for other, _, two in held if other == j]
        return pd.concat(found).groupby(["vec_id", "root"], as_index=False)["links"].sum()[["vec_id", "links", "root"]] if found else NO_LINKS

    return tasks.groupBy("i", "j").applyInPandas(meet_tiles, "vec_id long, links long, root long")


def _links_of_few(vectors: DataFrame, threshold: float) -> DataFrame:
    """The same of all dimensions that few vectors have, a block each."""

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("vec_id")
        return dual_links(CoverTree(p["vec_id"].to_numpy(np.int64), np.array(p["x"].tolist())), None, threshold)

    return vectors.groupBy(F.size("x").alias("size")).applyInPandas(meet, "vec_id long, links long, root long")


def embedding_dedup(vectors: DataFrame, threshold: float = 0.9, block: int = 2048, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Links are exact: all pairs whose cosine, in double precision, is threshold or more. Vectors are dealt to the
    nearest of at most 4096 pivots, the top of the cover tree, which a bounded sample gives; a cell's vectors, however
    many, form blocks of about `block`, each with its own tree. Two blocks meet if their cells' covering radii leave a
    pair within reach. A meeting returns a count and a root a vector, never the pairs, so thousands of copies are
    thousands of rows. Null vectors and those with null or non-finite components or no length link with nothing,
    as do vectors of another dimension; dimensions that at most `block` vectors have share one pass, others have one each.
    Rows that repeat a vec_id are one vector, with the smallest embedding among
    them; rows with a null vec_id become one row without links. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    one = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("x")).groupBy("vec_id").agg(F.min("x").alias("x"))
    fit = F.col("vec_id").isNotNull() & F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.exists("x", lambda v: v != 0)
    usable, _ = stored(one.where(fit), "vectors")
    size = F.size("x")
    large = sorted(tuple(r) for r in usable.groupBy(size).count().where(F.col("count") > block).collect())
    partial = _links_of_few(usable.where(~size.isin([k for k, _ in large])) if large else usable, threshold)
    for k, n in large:
        partial = partial.unionByName(_links_of(usable.where(size == k), n, threshold, block))
    partial, _ = stored(partial, "vector-links")
    links, _ = stored(partial.groupBy("vec_id").agg(F.sum("links").alias("n_links")), "link-counts")
    found = components(partial.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    out = one.select("vec_id").join(links, "vec_id", "left").join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings; embedding_dedup states every case."""
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9
), r AS (
  SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, v.vec_id) AS component_id, v.vec_id = coalesce(c.c, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""
