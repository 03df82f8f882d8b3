"""Operator 8: approximate nearest neighbours by inner product over balanced posting lists.

Vectors are lifted by one component, ``sqrt(M**2 - |x|**2)`` (``M`` the largest norm), so that the largest inner
product is the smallest distance. A bounded sample gives the centroids of the posting lists: it is halved again and
again by a two-means split at the median, so lists are balanced. A graph that joins each centroid to
its nearest ones is searched best first, in memory, for the centroids next to a vector. A vector near the boundary of
several lists is copied into each whose distance is at most ``1 + REPLICATE`` times the nearest one's; a
query reads every list whose distance is at most ``1 + PRUNE`` times its nearest.

Equal vectors are one entry with the ``k + 1`` smallest ids: they tie at every query, and ties go to the smaller id,
so no other id of theirs can be among the ``k`` nearest. A posting list is stored in blocks of at most
``BLOCK`` entries, and a query goes to all blocks of its lists, so no list is gathered in one task and none is cut.
Queries are grouped likewise, and blocks of both sides meet in a join on the list. Centroids and graph are
at most ``LISTS`` vectors; only they are broadcast. The number of lists follows the number of vectors up to that bound.

A task sends on only the best entries of each query over all lists it has read.

Scores are exact inner products in double precision of the original vectors; the method only chooses which are compared.

Defined results: null vectors, zero vectors, vectors with null or non-finite components and vectors whose length isn't
the table's most frequent (the smaller of equally frequent ones) take no part, as query or candidate; neither do rows with
a null id. Repeated rows of an id count once if their vectors are equal, else the first by value counts. With fewer candidates than ``k``
all that are found are returned; with a single list that is all of them. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiopanel.llm.ship import ship
from regiopanel.llm.words import column
from regiopanel.session import materialize

#: Neighbours of a query.
K = 20
#: Vectors of a posting list wanted, lists at most, sampled vectors for each list, and entries of a block.
LIST, LISTS, SAMPLED, BLOCK = 512, 4096, 32, 4096
#: Queries that travel together, and entries a task holds back to combine them over its lists.
QUERIES, HELD = 256, 200_000
#: Distance ratios up to which a vector is copied to more lists, and a query reads more lists.
REPLICATE, PRUNE = 0.01, 0.15
#: Neighbours of a centroid in the graph, and the size of the search's frontier beyond what is returned.
DEGREE, FRONTIER = 24, 64


class Lists:
    """Centroids, and the graph that finds those next to a vector."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7):
        self.centers = split(sample, lists, np.random.default_rng(seed))
        n = len(self.centers)
        self.neighbours = np.empty((n, min(n - 1, DEGREE)), np.int32)
        squares = (self.centers ** 2).sum(1)
        for at in range(0, n, 256):
            some = self.centers[at:at + 256]
            d = squares[None] - 2 * some @ self.centers.T
            d[np.arange(len(some)), at + np.arange(len(some))] = np.inf
            self.neighbours[at:at + 256] = np.argsort(d, axis=1)[:, :self.neighbours.shape[1]]
        back: list[set] = [set(x.tolist()) for x in self.neighbours]
        for i, x in enumerate(self.neighbours.tolist()):  # links go both ways, so that no centroid is cut off
            for j in x:
                back[j].add(i)
        for i in range(1, n):  # and a tree joins what would be separate parts
            back[i].add((i - 1) // 2)
            back[(i - 1) // 2].add(i)
        self.graph = [np.array(sorted(x), np.int64) for x in back]

    def near(self, vector: np.ndarray, ratio: float) -> list[int]:
        """Lists whose centroid is at most ``1 + ratio`` times as far as the nearest, nearest first: best-first search.

        It ends once ``FRONTIER`` centroids beyond the ratio have been seen that are all nearer than what is left.
        """
        centers, graph = self.centers, self.graph
        distance = lambda ids: np.sqrt(((centers[ids] - vector) ** 2).sum(1))
        seen = np.zeros(len(centers), bool)
        seen[0] = True
        first = float(distance(np.array([0]))[0])
        todo, found = [(first, 0)], [(first, 0)]
        best, beyond = first, []
        while todo:
            d, at = heapq.heappop(todo)
            if len(beyond) >= FRONTIER and d > -beyond[0] and d > (1 + ratio) * best:
                break
            new = graph[at][~seen[graph[at]]]
            if not len(new):
                continue
            seen[new] = True
            for e, i in zip(distance(new).tolist(), new.tolist()):
                best = min(best, e)
                if len(beyond) >= FRONTIER and e > -beyond[0] and e > (1 + ratio) * best:
                    continue
                heapq.heappush(todo, (e, i))
                found.append((e, i))
                heapq.heappush(beyond, -e)
                if len(beyond) > FRONTIER:
                    heapq.heappop(beyond)
        return [i for e, i in sorted(found) if e <= (1 + ratio) * best]


def split(points: np.ndarray, lists: int, rng) -> np.ndarray:
    """Centroids of ``lists`` parts of about equal size: two means, cut at the median, again and again."""
    if lists <= 1 or len(points) < 2:
        return points.mean(0, keepdims=True)
    a, b = points[rng.choice(len(points), 2, replace=False)]
    share = (lists // 2) / lists
    for _ in range(6):
        side = points @ (b - a)
        cut = np.argsort(side, kind="stable")
        half = max(1, min(len(points) - 1, round(len(points) * share)))
        a, b = points[cut[:half]].mean(0), points[cut[half:]].mean(0)
    return np.concatenate([split(points[cut[:half]], lists // 2, rng), split(points[cut[half:]], lists - lists // 2, rng)])


def lift(vectors: np.ndarray, norm: float) -> np.ndarray:
    """The vectors with the component that gives all of them the length ``norm``."""
    rest = np.sqrt(np.maximum(0.0, norm * norm - (vectors ** 2).sum(1)))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` (doubles) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) &
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(array) -> np.ndarray:
    flat = array.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 1)


class _Best:
    """The best entries of each query that a task has met so far; what it sends on is combined over its lists."""

    def __init__(self, most: int):
        self.most = most
        self.take()

    def add(self, queries: np.ndarray, scores: np.ndarray, ids) -> None:
        self.parts.append((queries, scores, ids))
        self.pending += len(queries)

    def prune(self) -> None:
        """Keep a query's ``most`` best entries, ties with the last of them included; an entry met in several lists counts once."""
        if not self.parts:
            return
        queries, scores = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        ids = pa.concat_arrays([p[2] for p in self.parts])
        first = pa.compute.list_element(ids, 0).to_numpy(zero_copy_only=False)
        order = np.lexsort((first, queries))
        once = np.ones(len(order), bool)
        once[1:] = (queries[order][1:] != queries[order][:-1]) | (first[order][1:] != first[order][:-1])
        order = order[once]
        order = order[np.lexsort((-scores[order], queries[order]))]
        starts = np.flatnonzero(np.concatenate([[True], queries[order][1:] != queries[order][:-1]]))
        sizes = np.diff(np.append(starts, len(order)))
        border = scores[order][starts + np.minimum(sizes, self.most) - 1]
        order = order[scores[order] >= np.repeat(border - 1e-9 * np.abs(border) - 1e-12, sizes)]
        self.parts = [(queries[order], scores[order], ids.take(pa.array(order)))]
        self.pending = len(order)

    def take(self) -> pa.RecordBatch:
        """What is held, as rows; nothing is held afterwards."""
        parts = getattr(self, "parts", None) or [(np.zeros(0, np.int64), np.zeros(0), pa.array([], pa.list_(pa.int64())))]
        self.parts, self.pending = [], 0
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([p[0] for p in parts]), pa.int64()), pa.concat_arrays([p[2] for p in parts]).cast(pa.list_(pa.int64())),
            pa.array(np.concatenate([p[1] for p in parts]), pa.float64())], ["query", "ids", "score"])


def _assigned(rows: DataFrame, index, norm: float, ratio: float) -> DataFrame:
    """A row for each list of each vector."""
    keep = [f for f in rows.schema.fields]
    names = [f.name for f in keep]

    def run(batches):
        lists = index.value
        for batch in batches:
            vectors = _matrix(column(batch, "v"))
            vectors = np.concatenate([vectors, np.zeros((len(vectors), 1))], 1) if norm is None else lift(vectors, norm)
            found = [lists.near(x, ratio) for x in vectors]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, n).take(at) for n in names] +
                                             [pa.array([i for x in found for i in x], pa.int32())], [*names, "list"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", list int")


def nearest(df: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", prune: float = PRUNE,
            replicate: float = REPLICATE, list_size: int = LIST, max_lists: int = LISTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows with ``is_query`` (a condition on ``vec_id``) the nearest others found."""
    spark = df.sparkSession
    rows = materialize(usable(df, id_col, vector_col), "vectors")
    # Equal vectors are one entry; the window keeps k + 1 ids of each, in every task before the shuffle.
    ranked = Window.partitionBy("v").orderBy("vec_id")
    entries = rows.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1).groupBy("v").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = materialize(entries, "vector-entries")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, norm = entries.agg(F.count("*"), F.sqrt(F.max(length))).first()
    queries = rows.where(is_query).groupBy("v").agg(F.min("vec_id").alias("query"))  # equal queries are asked once
    lists = max(1, min(max_lists, -(-n // list_size)))
    share = min(1.0, lists * SAMPLED / max(n, 1))  # about ``lists * SAMPLED`` entries, chosen by hash in each task
    sample = entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("v").toPandas()["v"] if n else []
    vectors = np.array([list(x) for x in sample]) if len(sample) else np.zeros((1, 1))
    vectors = vectors[np.lexsort(vectors.T)]  # in one order, however the rows came
    index = spark.sparkContext.broadcast(Lists(lift(vectors, norm or 0.0), lists))

    block = lambda h, size: F.floor(F.pmod(F.xxhash64(h), F.lit(1 << 30)) * F.ceil(F.col("n") / size) / (1 << 30)).cast("int")

    def packed(of: DataFrame, size: int, keep: str) -> DataFrame:
        """Rows of a list in blocks of about ``size``; how many a list has is counted first."""
        counts = of.groupBy("list").agg(F.count("*").alias("n"))
        return of.join(counts, "list").groupBy("list", block(keep, size).alias("block")).agg(
            F.collect_list(F.struct(keep, "v")).alias("rows")).select("list", F.col(f"rows.{keep}").alias(keep), F.col("rows.v").alias("v" + keep))

    posted = packed(materialize(_assigned(entries, index, norm or 0.0, replicate), "posting-lists"), BLOCK, "ids")
    asked = packed(materialize(_assigned(queries, index, None, prune), "query-lists"), QUERIES, "query")

    def compare(batches):
        best = _Best(k + 1)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = column(batch, "ids")[i].values
                queries = column(batch, "query")[i].values.to_numpy()
                posts, asks = _matrix(column(batch, "vids")[i].values), _matrix(column(batch, "vquery")[i].values)
                scores = asks @ posts.T
                most = min(k + 1, scores.shape[1])
                # ties at the border are kept, whatever their number: the ids decide later
                border = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
                q, p = np.nonzero(scores >= (border - 1e-9 * np.abs(border) - 1e-12)[:, None])
                best.add(queries[q], (asks[q] * posts[p]).sum(1), ids.take(pa.array(p)))
                if best.pending > 4 * HELD:
                    best.prune()
                    if best.pending > HELD:
                        yield best.take()
        best.prune()
        yield best.take()

    met = posted.join(asked, "list").select("ids", "vids", "query", "vquery").mapInArrow(compare, "query long, ids array<long>, score double")
    met = met.select("query", "score", F.explode("ids").alias("vec_id")).groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = materialize(met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).select("query", "vec_id", "score"), "neighbours")
    # Each query row gets its vector's neighbours without itself.
    every = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").join(queries, "v").select("query_id", "query")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = every.join(best, "query").where("vec_id != query_id").withColumn("rank", F.row_number().over(own).cast("int"))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
