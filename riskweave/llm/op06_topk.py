"""Exact inner-product search: ball trees per shard, branch and bound, a shared score to beat.

Rows of one id and one vector are counted first, then dealt to shards of about ``SHARD`` rows by the hash of
id and vector, so neither an id nor a vector that fills a third of the table makes a large shard. A task reads a
shard, builds its ball tree once, and then streams the queries past it batch by batch: what it holds is one
tree and one batch. The tree opens nodes for each query in falling order of the bound ``q.c + |q| r``; a node
whose bound is under the query's current k-th score is not opened. Scores are exact integers; the bound
carries a margin for floating point, and nodes at the k-th score itself are opened, so ties are settled by id.
Vectors stay in one place, queries are copied to each shard: for n rows and q queries n + q n / ``SHARD`` rows move.

The current k-th score is shared between shards in waves: each query searches one shard first, and takes
the k-th score found there into the search of all others, where it prunes from the start.

Of equal vectors in a shard only rows of the ``k + 1`` smallest different ids can be among a result, ``k`` of each
id, so the tree holds each vector once; a vector that fills a third of the table costs one point.

Rules: a vector that is null or empty, or holds a null or a component that is not finite, takes no part;
vectors meet those of their own length only; repeated ids are rows of their own, but a query never meets
rows of its own id; other columns are not read. Components and scores are 64-bit integers; where the square of the
longest vector could pass them, an error says so before anything is searched.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.shared import lean, ship, stored

SHARD = 8192
LEAF = 48
#: Queries whose bounds over all nodes are held at once.
STEP = 512
SCALE = 256


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when((F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)),
                  F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def smallest(ids: np.ndarray, k: int) -> np.ndarray:
    """Of ascending ids the ``k + 1`` smallest different ones, each up to ``k`` times."""
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    number = np.cumsum(first) - 1
    copy = np.arange(len(ids)) - np.flatnonzero(first)[number]
    return ids[(number <= k) & (copy < k)]


class BallTree:
    """Over distinct integer vectors; ``ids[i]`` are the smallest ids of vector i, ascending."""

    def __init__(self, points: np.ndarray, ids: list[np.ndarray], leaf: int = LEAF):
        self.points, self.ids = points, ids
        real = points.astype(np.float64)
        centers, radii, self.children, self.members = [], [], [], []
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            at, parent, side = todo.pop()
            here = len(centers)
            block = real[at]
            center = block.mean(axis=0)
            far = np.sqrt(((block - center) ** 2).sum(axis=1))
            centers.append(center)
            radii.append(far.max())
            self.children.append([])
            self.members.append(at)
            if parent >= 0:
                self.children[parent].append(here)
            if len(at) > leaf:
                one = block[far.argmax()]
                two = block[((block - one) ** 2).sum(axis=1).argmax()]
                order = np.argsort(block @ (two - one), kind="stable")
                half = len(at) // 2
                todo += [(at[order[:half]], here, 0), (at[order[half:]], here, 1)]
        self.centers, self.radii = np.array(centers), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        real = queries.astype(np.float64)
        norm = np.sqrt((real ** 2).sum(axis=1))[:, None]
        reach = np.sqrt((self.centers ** 2).sum(axis=1)) + self.radii
        return real @ self.centers.T + norm * self.radii + (norm * reach * 1e-9 + 1.0)

    def search(self, query: np.ndarray, own: int | None, k: int, bound: np.ndarray, beat: float) -> list[tuple[int, int]]:
        """The best (score, -id), unordered, all that can be among the k best and score at least ``beat``."""
        best: list[tuple[int, int]] = []
        kth = beat
        heap = [(-bound[0], 0)]
        while heap:
            most, node = heapq.heappop(heap)
            if -most < kth:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bound[child] >= kth:
                        heapq.heappush(heap, (-min(-most, bound[child]), child))
                continue
            members = self.members[node]
            scores = self.points[members] @ query
            for j in np.flatnonzero(scores >= kth):
                score = int(scores[j])
                if score < kth:
                    continue
                for x in self.ids[members[j]]:
                    if x == own:
                        continue
                    entry = (score, -int(x))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    else:
                        break
                if len(best) == k:
                    kth = max(kth, best[0][0])
        return best


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.int64)


def _tree(rows: pa.Table, k: int) -> BallTree:
    """Over (id, v, copies), each vector once."""
    ids = np.repeat(rows.column("id").to_numpy(), rows.column("copies").to_numpy())
    points, group = np.unique(_matrix(rows.column("v"), rows.num_rows), axis=0, return_inverse=True)
    group = np.repeat(group.ravel(), rows.column("copies").to_numpy())
    order = np.lexsort((ids, group))
    edges = np.searchsorted(group[order], np.arange(len(points) + 1))
    return BallTree(points, [smallest(ids[order[a:b]], k) for a, b in zip(edges[:-1], edges[1:])])


_ROW = ("dim", "shard", "asks", "id", "v", "copies", "beat")


def _search(k: int):
    """Over rows ordered by (dim, shard, asks): the vectors of a shard, then the queries for it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, tree = None, [], None
        for batch in batches:
            dim, shard = batch.column("dim").to_numpy(), batch.column("shard").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            change = np.flatnonzero((np.diff(dim) != 0) | (np.diff(shard) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if (dim[a], shard[a]) != here:
                    here, held, tree = (dim[a], shard[a]), [], None
                if not asks[a]:
                    held.append(part)
                    continue
                if held:
                    tree, held = _tree(pa.Table.from_batches(held), k), []
                if tree is None:                  # no vector of this length in the shard
                    continue
                out: list[tuple[int, int, int]] = []
                for i in range(0, part.num_rows, STEP):
                    some = part.slice(i, STEP)
                    asked = _matrix(some.column("v"), some.num_rows)
                    bounds = tree.bounds(asked)
                    for j, (name, beat) in enumerate(zip(some.column("id").to_pylist(), some.column("beat").to_pylist())):
                        out += [(name, s, -x) for s, x in tree.search(asked[j], name, k, bounds[j], -math.inf if beat is None else beat)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["query_id", "score", "vec_id"])

    return run


def _wave(vectors: DataFrame, queries: DataFrame, k: int, shards: int) -> DataFrame:
    """query_id, score, vec_id: what each query finds in the shard it names."""
    rows = vectors.select(*_ROW).unionByName(queries.select(*_ROW))
    return (rows.repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "asks")
            .mapInArrow(lean(_search(k)), "query_id long, score long, vec_id long"))


def top_k(table: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
          shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row that ``is_query`` (of ``vec_id``) holds for."""
    ship(table.sparkSession)
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector)).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    # a query's result holds at most k rows, so more than k copies of a row do not count
    rows = stored(rows.groupBy("vec_id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
                  .withColumn("dim", F.size("v")), "topk-rows")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("most")).first()
    if counts["most"] is not None and counts["most"] >= 2.0 ** 62:
        raise ValueError(f"inner products of up to {counts['most']:.3g} do not fit 64 bits")
    shards = max(1, math.ceil(counts["n"] / shard))
    vectors = rows.select("dim", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"),
                          F.col("vec_id").alias("id"), "v", "copies", F.lit(None).cast("long").alias("beat"))
    asked = rows.where(is_query).select("dim", F.lit(True).alias("asks"), F.col("vec_id").alias("id"), "v", "copies",
                                        F.pmod(F.xxhash64("v", "vec_id"), F.lit(shards)).cast("int").alias("home"))
    first = stored(_wave(vectors, asked.select("*", F.col("home").alias("shard"), F.lit(None).cast("long").alias("beat")), k, shards), "topk-first")
    kth = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("beat"))
    rest = asked.join(kth, "id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard != home")
    second = _wave(vectors, rest, k, shards)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(second).select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
