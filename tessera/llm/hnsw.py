"""Approximate nearest neighbours with one navigable small-world graph for each shard.

Vectors are dealt into shards of about ``SHARD`` by a hash of their id (and by
their length), and each shard's hierarchical graph is built in one task and kept
as flat arrays of neighbours.  A task gets a few shards and, first of all, the
queries, at most about ``QUERY_BLOCK``: it builds one graph after another, asks
it all queries (``ABREAST`` of them side by side) and keeps the nearest of each,
which are merged by distance.  The size of a shard, and what a task holds, don't
grow with the data.  A task gets so many shards that the queries, which go to
every task, are no more rows in all than the vectors; they are shuffled like
these and never sent to the driver.

In a shard, vectors are inserted one after another.  A new one's candidates on a
layer are the nearest that are already there, by the shard's table of distances
(its size is fixed), and are thinned out so that links point into different
directions.  Equal vectors share a node.

Defined results: vectors that are null, zero, or hold a null or a non-finite
component take no part, nor do rows with a null id; a query is compared with
vectors of its own length only; ties in distance go to the smaller id; a row is
never its own neighbour, nor is another row with its id; with fewer candidates
than asked for all are returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import batch, small_batches

SHARD = 4096
#: Links of a node on the upper layers and on the lowest one.
LINKS, LINKS_0 = 12, 24
#: Candidates of an insertion, and of a search.
EF_BUILD, EF_SEARCH = 48, 80
#: Queries that a task holds while its shards pass.
QUERY_BLOCK = 16384
#: Size of a component beyond which a shard's table of distances is made of scaled vectors.
LARGE = 1e150
#: Queries that are searched for side by side in a graph.
ABREAST = 64


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


class Graph:
    """The layers of one shard: ``links[l][node]`` are its neighbours, padded with -1."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, inverse = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        rank = np.argsort(np.argsort(first))  # nodes in the order of their smallest id
        node_of = rank[inverse.ravel()]
        by_node = np.argsort(node_of, kind="stable")
        self.vectors = vectors[np.sort(first)]
        n = len(self.vectors)
        self.owner_at = np.searchsorted(node_of[by_node], np.arange(n + 1))
        self.owners = ids[by_node]
        self.links: list[np.ndarray] = []
        self.entry = 0
        if n:
            self._build(n)

    def _build(self, n: int) -> None:
        x = self.vectors.astype(np.float64)
        if (largest := np.abs(x).max()) > LARGE:  # else squares would pass what a double holds
            x = x / largest
        sq = (x * x).sum(axis=1)
        dist = x @ x.T
        dist *= -2
        dist += sq[:, None]
        dist += sq[None, :]
        u = [(xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 3) + 1) / 2**64 for i in self.owners[self.owner_at[:-1]]]
        level = np.array([int(-math.log(v) / math.log(LINKS)) for v in u])
        self.entry = int(np.argmax(level))
        for layer in range(int(level.max()) + 1):
            nodes, most = np.flatnonzero(level >= layer), LINKS if layer else LINKS_0
            near: dict[int, list[int]] = {}
            for k, node in enumerate(map(int, nodes)):
                before = nodes[:k]
                d = dist[node, before]
                if k > EF_BUILD:
                    pick = np.argpartition(d, EF_BUILD)[:EF_BUILD]
                    before, d = before[pick], d[pick]
                near[node] = kept = thinned(dist, before[np.argsort(d, kind="stable")], node, LINKS)
                for other in kept:
                    back = near[other]
                    back.append(node)
                    if len(back) > 2 * most:
                        c = np.array(back)
                        near[other] = thinned(dist, c[np.argsort(dist[other, c], kind="stable")], other, most)
            flat = np.full((n, 2 * most), -1, dtype=np.int32)
            for node, kept in near.items():
                flat[node, : len(kept)] = kept
            self.links.append(flat)

    def search(self, queries: np.ndarray, ef: int = EF_SEARCH) -> list[np.ndarray]:
        """For each row of ``queries`` the nodes found nearest to it, at most ``ef``.

        All rows go one step at a time, each on its own: it opens the nearest node it has found and not opened yet, and
        ends when it has opened the ``ef`` nearest it knows.
        """
        x, n, m = self.vectors, len(self.vectors), len(queries)
        at = np.full(m, self.entry)
        best = squares(x[at], queries)
        for links in self.links[:0:-1]:
            moving = np.arange(m)
            while len(moving):
                c = links[at[moving]]
                d = np.where(c >= 0, squares(x[c], queries[moving, None]), np.inf)
                first = np.arange(len(moving)), d.argmin(axis=1)
                closer = d[first] < best[moving]
                moving, to, d = moving[closer], c[first][closer], d[first][closer]
                at[moving], best[moving] = to, d
        near, nodes, opened = np.full((m, ef), np.inf), np.full((m, ef), -1), np.ones((m, ef), dtype=bool)
        near[:, 0], nodes[:, 0], opened[:, 0] = best, at, False
        new = np.ones((m, n + 1), dtype=bool)  # the last column stands for the -1 of missing links
        new[:, n] = False
        new[np.arange(m), at] = False
        out: list[np.ndarray] = [at[:0]] * m
        rows = np.arange(m)
        while True:
            d = np.where(opened, np.inf, near)
            k = d.argmin(axis=1)
            going = d[np.arange(len(rows)), k] < np.inf
            if not going.all():
                for i in np.flatnonzero(~going):
                    out[rows[i]] = nodes[i][nodes[i] >= 0]
                near, nodes, opened, new, queries, rows, k = (v[going] for v in (near, nodes, opened, new, queries, rows, k))
                if not len(rows):
                    return out
            each = np.arange(len(rows))
            opened[each, k] = True
            c = self.links[0][nodes[each, k]]
            r, k = np.nonzero(new[each[:, None], c])
            c = c[r, k]
            new[r, c] = False
            d = squares(x[c], queries[r])
            closer = d < near.max(axis=1)[r]
            r, c, d = r[closer], c[closer], d[closer]
            if len(r):
                k = np.arange(len(r)) - np.searchsorted(r, r)
                shape = len(rows), int(k.max()) + 1
                added = np.full(shape, np.inf), np.full(shape, -1), np.ones(shape, dtype=bool)
                for v, value in zip(added, (d, c, False)):
                    v[r, k] = value
                near, nodes, opened = (np.concatenate(v, axis=1) for v in zip((near, nodes, opened), added))
                kept = np.argpartition(near, ef - 1, axis=1)[:, :ef]
                near, nodes, opened = (np.take_along_axis(v, kept, axis=1) for v in (near, nodes, opened))

    def nearest(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(distance, id) of the ``k`` nearest found, nearest first, ties to the smaller id."""
        return next(self.nearest_of_each([query_id], q[None], k))

    def nearest_of_each(self, query_ids: list[int], queries: np.ndarray, k: int) -> Iterator[list[tuple[float, int]]]:
        """``nearest`` of each row of ``queries``."""
        for i in range(0, len(query_ids), ABREAST):
            rows = queries[i : i + ABREAST]
            found = self.search(rows) if len(self.vectors) else [np.zeros(0, dtype=int)] * len(rows)
            for query_id, q, nodes in zip(query_ids[i : i + ABREAST], rows, found):
                yield self._owned(query_id, q, nodes, k)

    def _owned(self, query_id: int, q: np.ndarray, nodes: np.ndarray, k: int) -> list[tuple[float, int]]:
        d = np.sqrt(((self.vectors[nodes] - q) ** 2).sum(axis=1))
        out = []
        for dd, node in sorted(zip(d.tolist(), nodes.tolist())):
            if len(out) >= k and dd > out[k - 1][0]:
                break
            own = self.owners[self.owner_at[node] : min(self.owner_at[node + 1], self.owner_at[node] + k + 1)]
            out = sorted(out + [(dd, int(i)) for i in own if i != query_id])
        return out[:k]

    def packed(self) -> tuple:
        """The flat arrays as bytes."""
        links = np.concatenate([x.ravel() for x in self.links]) if self.links else np.zeros(0, np.int32)
        return (len(self.vectors), self.entry, self.vectors.astype("<f8").tobytes(), self.owners.astype("<i8").tobytes(), self.owner_at.astype("<i4").tobytes(), [x.shape[1] for x in self.links], links.astype("<i4").tobytes())

    @classmethod
    def unpacked(cls, n: int, entry: int, vectors: bytes, owners: bytes, owner_at: bytes, widths: list[int], links: bytes) -> Graph:
        g = cls.__new__(cls)
        g.entry, g.vectors = entry, np.frombuffer(vectors, "<f8").reshape(n, -1)
        g.owners, g.owner_at = np.frombuffer(owners, "<i8"), np.frombuffer(owner_at, "<i4")
        flat, at, g.links = np.frombuffer(links, "<i4"), 0, []
        for w in widths:
            g.links.append(flat[at : at + n * w].reshape(n, w))
            at += n * w
        return g


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, at most the largest double."""
    d = a - b
    return np.minimum(np.einsum("...i,...i->...", d, d), np.finfo(np.float64).max)


def thinned(dist: np.ndarray, candidates: np.ndarray, node: int, most: int) -> list[int]:
    """Of candidates, nearest first, those that are nearer to ``node`` than to any one already kept."""
    if len(candidates) <= 2:
        return candidates.tolist()
    among, own = dist[np.ix_(candidates, candidates)], dist[node, candidates]
    kept: list[int] = []
    nearest_kept = np.full(len(candidates), np.inf)
    for k in range(len(candidates)):
        if own[k] < nearest_kept[k]:
            kept.append(k)
            if len(kept) == most:
                break
            np.minimum(nearest_kept, among[k], out=nearest_kept)
    return candidates[kept].tolist()


INDEX_DDL = "shard bigint, n int, entry int, vectors binary, owners binary, owner_at binary, widths array<int>, links binary"


def shard_of(vec_id: str, shards: int) -> Column:
    """The shard of a vector among those of its length."""
    return F.pmod(F.xxhash64(vec_id), F.lit(shards))


def build(vectors: DataFrame, shards: int) -> DataFrame:
    """The index as a table, a row for each shard, of the rows (vec_id, embedding) that take part."""
    dealt = vectors.withColumn("shard", F.size("embedding").cast("long") * shards + shard_of("vec_id", shards))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = Graph(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
        return pd.DataFrame([(pdf["shard"].iloc[0], *g.packed())], columns=["shard", "n", "entry", "vectors", "owners", "owner_at", "widths", "links"])

    return dealt.groupBy("shard").applyInPandas(run, INDEX_DDL)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(length, shard, ids, vectors) of rows that stand together in a batch and have the same length and shard."""
    for b in batches:
        length, shard, ids = (b.column(c).to_numpy() for c in ("length", "shard", "id"))
        starts = np.flatnonzero((np.diff(length) != 0) | (np.diff(shard) != 0)) + 1
        for i, j in pairwise([0, *starts.tolist(), b.num_rows]):
            if i < j:
                flat = b.column("embedding").slice(i, j - i).flatten().to_numpy(zero_copy_only=False)
                yield int(length[i]), int(shard[i]), ids[i:j], flat.astype(np.float64).reshape(j - i, -1)


def _in_shards(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[tuple[int, int, float]]]:
    """(query_id, vec_id, score) of the ``k`` nearest of each query; of each length, queries (shard -1) come first, then shard after shard."""
    for _, same_length in groupby(_pieces(batches), lambda p: p[0]):
        query_ids: list[int] = []
        for shard, pieces in groupby(same_length, lambda p: p[1]):
            ids, vectors = (np.concatenate(x) for x in zip(*(p[2:] for p in pieces)))
            if shard < 0:
                query_ids, asked, best = ids.tolist(), vectors, [[] for _ in ids]
            elif query_ids:
                g = Graph(ids, vectors)
                best = [sorted({*near, *more})[:k] for near, more in zip(best, g.nearest_of_each(query_ids, asked, k))]
        if query_ids:
            yield [(i, vec_id, d) for i, near in zip(query_ids, best) for d, vec_id in near]


def nearest(df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: of each row for which ``queries`` holds, the ``k`` nearest rows found."""
    spark = df.sparkSession
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    asked = rows.where(queries).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("embedding"))
    total, n_asked = (df.select(F.count(F.col(id_col)), F.count_if(queries)).first())
    shards, blocks = max(1, math.ceil(total / SHARD)), max(1, math.ceil(n_asked / QUERY_BLOCK))
    groups = math.ceil(shards / max(1, math.ceil(shards * n_asked / max(1, total))))
    group, block = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (groups, blocks))
    kept = vectors.select("vec_id", "embedding", shard_of("vec_id", shards).alias("shard"), block.alias("block")).withColumn("group", F.col("shard") % groups)
    sent = asked.select("query_id", "embedding", F.lit(-1).cast("long").alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), group.alias("group"))
    task, length = (F.col("group") + F.col("block") * groups).cast("int").alias("task"), F.size("embedding").alias("length")
    rows = sent.select(task, length, "shard", F.col("query_id").alias("id"), "embedding").unionAll(kept.select(task, length, "shard", F.col("vec_id").alias("id"), "embedding"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _in_shards(batches, k):
            if out:
                yield batch(schema, list(zip(*out)))

    small_batches(spark)
    dealt = rows.repartitionById(groups * blocks, F.col("task")).drop("task").sortWithinPartitions("length", "shard")
    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double").repartition("query_id").distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
