"""Nearest vectors by inner product over balanced posting lists.

A last coordinate makes all vectors equally long, so that the largest inner product is the smallest
distance. Centroids are fitted on at most ``max_sample`` vectors, taken in the order of a hash: halving at the
median gives lists of equal size, a few rounds of k-means with a penalty on large lists refine them. Centroids,
at most ``max_lists``, are searched through an in-memory graph. Every vector is indexed: it is
posted to its nearest list, and one near a boundary also to lists up to ``post_ratio`` times as far. A query reads the
lists up to ``probe_ratio`` times as far as its nearest. A query that finds fewer than ``k`` vectors there, such as one far
from all others, reads four times as many lists, without regard to their distance, until it has ``k`` or has read all.

A list is read in blocks of at most about ``block`` vectors by blocks of queries, so a list of any size is spread. Of
identical vectors only the ``k + 1`` smallest ids can be among anyone's nearest, so more are not posted.

Defined results: vectors that are NULL, empty, zero, or hold a NULL or non-finite component take no part, and neither do
those whose length is not the most frequent one (of equally frequent ones the longest); ties go to the smaller vec_id; rows with a NULL vec_id
take no part; with fewer than ``k`` other vectors all of them are found; repeated vec_ids of one vector count once, a vec_id with several vectors is a candidate with each, and
counts once per query with its best score; a query of several vectors is answered for all of them together; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opscheck.llm.common import durable


@dataclass(frozen=True)
class VectorParameters:
    k: int = 20
    list_size: int = 160
    max_lists: int = 4096
    max_sample: int = 16_384
    rounds: int = 6
    degree: int = 24
    beam: int = 96
    max_posts: int = 4
    post_ratio: float = 1.06
    max_probes: int = 96
    probe_ratio: float = 1.35
    block: int = 4096
    seed: int = 3


class CentroidGraph:
    """Centroids and their nearest-neighbour graph; the search keeps the best ``beam`` for many vectors at once."""

    def __init__(self, centroids: np.ndarray, p: VectorParameters):
        self.centroids, self.p = centroids.astype(np.float32), p
        n = len(centroids)
        random = np.random.default_rng(p.seed)
        self.links = np.empty((n, min(n, p.degree) + 4), np.int64)
        for low in range(0, n, 1024):
            near = self._distances(self.centroids[low:low + 1024])
            self.links[low:low + 1024, :-4] = np.argpartition(near, min(n, p.degree) - 1, axis=1)[:, :min(n, p.degree)]
        self.links[:, -4:] = random.integers(0, n, (n, 4))  # long links keep the graph connected
        self.entries = random.choice(n, min(n, 16), replace=False)

    def _distances(self, x: np.ndarray) -> np.ndarray:
        return ((x ** 2).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids ** 2).sum(1)).clip(0)

    def search(self, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``count`` nearest centroids of every row found, nearest first, and their squared distances."""
        n = len(self.centroids)
        beam = min(n, max(self.p.beam, count))
        found = np.tile(self.entries, (len(x), 1))
        expanded = np.zeros((len(x), n), bool)
        while True:
            distance = np.take_along_axis(self._near(x, found), np.argsort(found, axis=1, kind="stable"), axis=1)
            found = np.sort(found, axis=1)
            distance[:, 1:][found[:, 1:] == found[:, :-1]] = np.inf
            best = np.argsort(distance, axis=1, kind="stable")[:, :beam]
            found, distance = np.take_along_axis(found, best, axis=1), np.take_along_axis(distance, best, axis=1)
            fresh = ~np.take_along_axis(expanded, found, axis=1) & np.isfinite(distance)
            if not fresh.any():
                return found[:, :count], distance[:, :count]
            first = np.argsort(~fresh, axis=1, kind="stable")[:, :8]  # the nearest not yet expanded
            chosen = np.take_along_axis(found, first, axis=1)
            np.put_along_axis(expanded, chosen, True, axis=1)
            found = np.concatenate((found, self.links[chosen].reshape(len(x), -1)), axis=1)

    def _near(self, x: np.ndarray, found: np.ndarray) -> np.ndarray:
        return ((self.centroids[found] - x[:, None, :]) ** 2).sum(2)


def fit_centroids(sample: np.ndarray, lists: int, p: VectorParameters) -> np.ndarray:
    """Balanced centroids: halves at the median of a two-means direction, then k-means with a size penalty."""
    random, parts = np.random.default_rng(p.seed), [np.arange(len(sample))]
    while len(parts) < lists and max(map(len, parts)) > 1:
        parts.sort(key=len)
        part = parts.pop()
        x = sample[part]
        ends = x[random.choice(len(part), 2, replace=False)]
        for _ in range(4):
            nearer = ((x - ends[0]) ** 2).sum(1) < ((x - ends[1]) ** 2).sum(1)
            if nearer.all() or not nearer.any():
                break
            ends = np.array([x[nearer].mean(0), x[~nearer].mean(0)])
        order = np.argsort(x @ (ends[1] - ends[0]), kind="stable")
        parts += [part[order[:len(part) // 2]], part[order[len(part) // 2:]]]
    centroids = np.array([sample[part].mean(0) for part in parts])
    sizes = np.array([len(part) for part in parts], float)
    for _ in range(p.rounds):
        near = (sample ** 2).sum(1)[:, None] - 2 * sample @ centroids.T + (centroids ** 2).sum(1)
        penalty = 0.1 * near.min(1).mean() * (sizes / sizes.mean() - 1)
        nearest = (near + penalty).argmin(1)
        sizes = np.bincount(nearest, minlength=len(centroids)).astype(float)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _posted(rows: DataFrame, graph, longest: float, count: int, ratio: float) -> DataFrame:
    """Rows with the lists they belong to: the nearest, and others up to ``ratio`` times as far."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.iloc[low:low + 1000]
                x = _matrix(part["embedding"])
                x = np.column_stack((x, np.sqrt(np.maximum(longest ** 2 - (x ** 2).sum(1), 0) * part["lifted"].to_numpy())))
                found, distance = graph.value.search(x.astype(np.float32), count)
                near = (distance <= ratio ** 2 * distance[:, :1] + 1e-9) if np.isfinite(ratio) else np.isfinite(distance)
                yield part.drop(columns="lifted").assign(lists=[f[n].tolist() for f, n in zip(found, near, strict=True)])

    return rows.mapInPandas(assign, "vec_id bigint, embedding array<double>, lists array<bigint>").select(
        "vec_id", "embedding", F.explode("lists").alias("list"))


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (``vec_id``, ``embedding``) rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
                       & F.exists("embedding", lambda x: x != 0)).distinct()
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.agg(F.max(F.struct("n", "size"))).first()[0]
    return rows.filter(F.size("embedding") == (usual["size"] if usual else 0))


def nearest(vectors: DataFrame, queries: DataFrame, p: VectorParameters = VectorParameters()) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest other vectors found of every query vector."""
    spark = vectors.sparkSession
    rows = durable(usable(vectors))
    asked = usable(queries)
    # identical vectors: only the smallest ids can be among the nearest; one more stands in for the query's own
    same = Window.partitionBy("embedding").orderBy("vec_id")
    rows = rows.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= p.k + 1).drop("place")
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    known = rows.agg(F.count("*").alias("n"), F.sqrt(F.max(squares)).alias("longest")).first()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not known["n"]:
        return spark.createDataFrame([], empty)
    longest = float(known["longest"])
    sample = _matrix(rows.orderBy(F.xxhash64("vec_id")).select("embedding").limit(p.max_sample).toPandas()["embedding"])
    sample = np.column_stack((sample, np.sqrt(np.maximum(longest ** 2 - (sample ** 2).sum(1), 0))))
    lists = int(min(p.max_lists, max(1, known["n"] // p.list_size)))
    graph = spark.sparkContext.broadcast(CentroidGraph(fit_centroids(sample, lists, p), p))  # bounded by max_lists

    # a query's own scale does not change its order; at the longest length it lies on the vectors' sphere
    size = F.sqrt(squares)
    scaled = asked.withColumn("probe", F.transform("embedding", lambda x: x / size * F.lit(longest)))
    posts = durable(_posted(rows.withColumn("lifted", F.lit(True)), graph, longest, p.max_posts, p.post_ratio))
    ratio_free = False
    found = durable(_answered(posts, scaled, asked, graph, longest, p.max_probes, p.probe_ratio, p))
    count = min(p.max_probes, lists)
    while True:
        enough = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= p.k).select(F.col("query_id").alias("vec_id"))
        short = durable(scaled.join(enough, "vec_id", "left_anti"))
        if (count == lists and ratio_free) or short.isEmpty():
            break
        count, ratio_free = min(4 * count, lists), True
        more = _answered(posts, short, asked, graph, longest, count, float("inf"), p)
        done = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")
        found = durable(done.unionByName(more))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.k).select(
        "query_id", "rank", "vec_id", "score")


def _answered(posts: DataFrame, scaled: DataFrame, asked: DataFrame, graph, longest: float, count: int, ratio: float,
              p: VectorParameters) -> DataFrame:
    """``query_id``, ``vec_id`` and ``score`` of the vectors found in the ``count`` nearest lists up to ``ratio`` times as far as the first."""
    probes = _posted(scaled.select("vec_id", F.col("probe").alias("embedding"), F.lit(False).alias("lifted")),
                     graph, longest, count, ratio).drop("embedding")
    probes = durable(probes.join(asked, "vec_id"))
    sizes = (posts.groupBy("list").agg(F.ceil(F.count("*") / p.block).alias("post_blocks"))
             .join(probes.groupBy("list").agg(F.ceil(F.count("*") / p.block).alias("probe_blocks")), "list"))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each row goes to one of its list's blocks, and there to every block of the other side."""
        mine = F.pmod(F.xxhash64("vec_id", F.lit(own)), F.col(own)).alias(f"_{own}")
        return side.join(sizes, "list").select("list", "vec_id", "embedding", mine,
                                               F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(f"_{other}"))

    def search(posted: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(posted) or not len(asked_):
            return pd.DataFrame(columns=columns)
        x, ids, out = _matrix(posted["embedding"]), posted["vec_id"].to_numpy(), []
        for query, vector in zip(asked_["vec_id"], _matrix(asked_["embedding"]), strict=True):
            rough = x @ vector
            rough[ids == query] = -np.inf
            if len(rough) > p.k:
                bound = np.partition(rough, -p.k)[-p.k]
                near = np.flatnonzero(rough >= bound - 1e-9 * (1 + abs(bound)))
            else:
                near = np.arange(len(rough))
            near = near[np.isfinite(rough[near])]
            # added up in the order of the components, so that equal vectors have equal scores
            score = np.add.accumulate(x[near] * vector, axis=1)[:, -1]
            best = np.lexsort((ids[near], -score))[:p.k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame(columns=columns)

    keys = ["list", "_post_blocks", "_probe_blocks"]
    found = (dealt(posts, "post_blocks", "probe_blocks").groupBy(keys)
             .cogroup(dealt(probes, "probe_blocks", "post_blocks").groupBy(keys))
             .applyInPandas(search, "query_id bigint, vec_id bigint, score double"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= p.k).drop("_place")
