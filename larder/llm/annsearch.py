"""Nearest neighbours by inner product: a robust-pruned directed graph for each shard.

Vectors are dealt by a hash of vec_id into shards of about ``SHARD_ROWS``. A task reads a shard, builds its
graph, then streams the queries through it, so it holds one shard and a block of queries. Building:
points are inserted in blocks; a greedy search from the entry points proposes neighbours, pruning
keeps a candidate unless one already kept is closer to it by the factor ``ALPHA``, and edges are made
in both directions. Entry points are the medoid, points far from one another, those of the greatest norms, and one for each part of
the graph that could not be reached from these, so that every point can be. Searching: a beam of nodes, the best ones expanded together for a block of queries,
until none of the beam is unexpanded. The beam starts at ``BEAM``; on a shard's first block of queries recall is measured against
all of the shard, and the beam doubles until ``RECALL`` is reached, however the vectors lie. A shard of at most ``SMALL`` vectors has a beam that
holds them all. The best ``k`` of all shards win.

Inner product is turned into distance by an added coordinate that makes all norms equal, which keeps its order for every query; equal
vectors of a shard are one node that names its smallest ids.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors are sought among those of
their own length; fewer candidates than k give all; ties go to the smaller vec_id; rows without vec_id take no part; rows that share a vec_id are one
vector (the least by components, if they differ) and one query. Scores are exact in double precision. An empty table gives an empty one; other columns only serve to name the queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import bound_batches, stored
from larder.llm.embdedup import matrix, usable

#: Rows of a shard, edges of a node, nodes of the beam when building and when searching begins, factor of pruning, points inserted and queries searched at once.
SHARD_ROWS, DEGREE, BUILD_BEAM, BEAM, ALPHA, BLOCK = 4096, 32, 64, 96, 1.2, 256
#: Entry points by distance and by norm; recall that the beam has to reach, queries it is measured on, and vectors of a shard searched whole.
FAR_ENTRIES, LONG_ENTRIES, RECALL, MEASURED, SMALL = 16, 16, 0.97, 64, 256


class Graph:
    """A directed graph over the rows of ``x``, for search by Euclidean distance."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, entries: np.ndarray | None = None) -> None:
        self.x, self.degree, self.alpha = x.astype(np.float32), degree, alpha
        self.norm = (self.x * self.x).sum(axis=1)
        n = len(x)
        self.edges = np.full((n, degree), -1, np.int64)
        medoid = int(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1).argmin())
        self.entries = self._far_apart(medoid, min(FAR_ENTRIES, n))
        order = np.random.RandomState(11).permutation(n)
        order = np.concatenate((self.entries, order[~np.isin(order, self.entries)]))
        at, size = 1, 8
        while at < n:
            self._insert(order[at : at + size])
            at, size = at + size, min(BLOCK, size * 2)
        if entries is not None:
            self.entries = np.unique(np.concatenate((self.entries, entries)))
        for at in range(0, n, BLOCK):
            self._insert(order[at : at + BLOCK])
        self._connect()

    def _far_apart(self, first: int, count: int) -> np.ndarray:
        """``first``, and each time the point furthest from those taken."""
        taken = [first]
        away = self.norm + self.norm[first] - 2 * self.x @ self.x[first]
        while len(taken) < count and (new := int(away.argmax())) not in taken:
            taken.append(new)
            away = np.minimum(away, self.norm + self.norm[new] - 2 * self.x @ self.x[new])
        return np.array(taken)

    def _connect(self) -> None:
        """Add an entry point for each part of the graph that no entry point leads to."""
        reached, edge, more = np.zeros(len(self.x), bool), self.entries, []
        while True:
            while len(edge):
                reached[edge] = True
                edge = np.unique(self.edges[edge])
                edge = edge[(edge >= 0) & ~reached[edge]]
            left = np.flatnonzero(~reached)
            if not len(left):
                break
            edge = left[:1]
            more.append(left[0])
        self.entries = np.concatenate((self.entries, np.array(more, np.int64)))

    def _insert(self, points: np.ndarray) -> None:
        found, _ = self.search(self.x[points], BUILD_BEAM)
        own = np.concatenate((found, self.edges[points]), axis=1)
        self.edges[points] = self._pruned(points, own)
        src, dst = np.repeat(points, self.degree), self.edges[points].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        nodes, first, counts = np.unique(dst, return_index=True, return_counts=True)
        for width in np.unique(counts):
            some = np.flatnonzero(counts == width)
            extra = src[first[some][:, None] + np.arange(width)]
            self.edges[nodes[some]] = self._pruned(nodes[some], np.concatenate((self.edges[nodes[some]], extra), axis=1))

    def _pruned(self, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        c = np.sort(candidates, axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c[c == points[:, None]] = -1
        x = self.x[c]
        d = self.norm[points][:, None] + self.norm[c] - 2 * np.matmul(x, self.x[points][:, :, None])[:, :, 0]
        d = np.where(c >= 0, np.maximum(d, 0), np.inf)
        apart = self.norm[c][:, :, None] + self.norm[c][:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        # What each candidate would keep out if it were taken.
        covers = self.alpha**2 * np.maximum(apart, 0) <= d[:, None, :]
        rows, out = np.arange(len(points)), np.full((len(points), self.degree), -1, np.int64)
        left = d.copy()
        for e in range(self.degree):
            best = left.argmin(axis=1)
            has = np.isfinite(left[rows, best])
            if not has.any():
                break
            out[has, e] = c[rows, best][has]
            left[covers[rows, best] & has[:, None]] = np.inf
            left[rows[has], best[has]] = np.inf
        return out

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of nearest nodes of each query (-1 where fewer) and their distances without the query's norm."""
        q = q.astype(np.float32)
        n, rows = len(q), np.arange(len(q))[:, None]
        ids, open_ = np.full((n, beam), -1, np.int64), np.zeros((n, beam), bool)
        dist = np.full((n, beam), np.inf, np.float32)
        begin = self.norm[self.entries] - 2 * q @ self.x[self.entries].T
        held = min(beam, len(self.entries))
        first = np.argpartition(begin, held - 1, axis=1)[:, :held]
        ids[:, :held], open_[:, :held], dist[:, :held] = self.entries[first], True, np.take_along_axis(begin, first, axis=1)
        seen = np.zeros((n, len(self.x)), bool)
        seen[:, self.entries] = True
        together = min(beam, max(2, beam // 48))
        live = np.arange(n)
        while len(live):
            waiting = np.where(open_[live], dist[live], np.inf)
            # The best open nodes of each beam are expanded together.
            best = np.argpartition(waiting, together - 1, axis=1)[:, :together]
            has = np.isfinite(np.take_along_axis(waiting, best, axis=1))
            go = has.any(axis=1)
            live, best, has = live[go], best[go], has[go]
            if not len(live):
                break
            open_[live[:, None], best] = False
            node = np.where(has, ids[live[:, None], best], -1)
            new = np.where((node >= 0)[:, :, None], self.edges[node], -1).reshape(len(live), -1)
            new = np.where((new >= 0) & ~seen[live[:, None], new], new, -1)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            r, c = np.nonzero(new >= 0)
            seen[live[r], new[r, c]] = True
            far = np.full(new.shape, np.inf, np.float32)
            far[r, c] = self.norm[new[r, c]] - 2 * np.einsum("nd,nd->n", q[live[r]], self.x[new[r, c]])
            every, all_ids = np.concatenate((dist[live], far), axis=1), np.concatenate((ids[live], new), axis=1)
            all_open = np.concatenate((open_[live], new >= 0), axis=1)
            top = np.argpartition(every, beam - 1, axis=1)[:, :beam]
            dist[live], ids[live], open_[live] = (np.take_along_axis(v, top, axis=1) for v in (every, all_ids, all_open))
        by = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, by, axis=1), np.take_along_axis(dist, by, axis=1)
        return np.where(np.isfinite(dist), ids, -1), dist


class Shard:
    """The distinct vectors of a shard, their smallest ids, and the graph over them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        by = np.argsort(ids, kind="stable")
        ids, x = ids[by], x[by]
        self.x, group = np.unique(x, axis=0, return_inverse=True)
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(len(self.x) + 1))
        self.ids = [ids[order[a : min(b, a + k + 1)]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.k = k
        scaled = self.x / np.abs(self.x).max()
        norm = (scaled * scaled).sum(axis=1)
        top = norm.max() ** 0.5
        self.graph = Graph(np.column_stack((scaled, np.sqrt(np.maximum(norm.max() - norm, 0)))) / top, entries=np.argsort(-norm, kind="stable")[:LONG_ENTRIES])
        self.beam = 0

    def _found(self, q: np.ndarray, beam: int) -> np.ndarray:
        q = q / np.linalg.norm(q / np.abs(q).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(q).max(axis=1, keepdims=True)
        return self.graph.search(np.column_stack((q, np.zeros(len(q)))), beam)[0]

    def _fit_beam(self, q: np.ndarray, beam: int) -> None:
        """The beam that reaches the target recall on some of the queries."""
        n, q = len(self.x), q[:MEASURED]
        self.beam = min(n, max(beam, 2 * self.k)) if n > SMALL else n
        k = min(n, self.k)
        exact = np.partition(q @ self.x.T, n - k, axis=1)[:, n - k][:, None]
        while self.beam < n:
            found = self._found(q, self.beam)
            score = np.where(found >= 0, np.einsum("nd,nkd->nk", q, self.x[found]), -np.inf)
            if (score >= exact - 1e-9 * np.abs(exact)).sum(axis=1).clip(max=k).mean() >= RECALL * k:
                break
            self.beam = min(n, 2 * self.beam)

    def nearest(self, qid: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec_id, score) of up to k rows for each query."""
        if not self.beam:
            self._fit_beam(q, beam)
        found, k = self._found(q, self.beam), self.k
        score = np.where(found >= 0, np.einsum("nd,nkd->nk", q, self.x[found]), -np.inf)
        by = np.argsort(-score, axis=1, kind="stable")
        out: tuple[list, list, list] = ([], [], [])
        for i, me in enumerate(qid.tolist()):
            best: list[tuple[float, int]] = []
            for j in by[i]:
                s = score[i, j]
                if not np.isfinite(s) or len(best) >= k and s < best[k - 1][0]:
                    break
                best += [(s, v) for v in self.ids[found[i, j]].tolist() if v != me]
            best.sort(key=lambda t: (-t[0], t[1]))
            for s, v in best[:k]:
                out[0].append(me)
                out[1].append(v)
                out[2].append(s)
        return tuple(np.array(o) for o in out)


def _searched(k: int, beam: int):  # noqa: ANN202
    def answered(shard: Shard, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.concat_batches(rows)
        q, v, score = shard.nearest(part.column(2).to_numpy(), matrix(part.column(3)), beam)
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, shard, waiting = None, [], None, []
        for batch in batches:
            lists, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, (lists[1:] != lists[:-1]) | (kinds[1:] != kinds[:-1])))
            for s, e in zip(starts, np.append(starts[1:], len(lists)), strict=True):
                rows = batch.slice(s, e - s)
                if lists[s] != now:
                    if waiting:
                        yield answered(shard, waiting)
                    now, members, shard, waiting = lists[s], [], None, []
                if kinds[s] == 0:
                    members.append((rows.column(2).to_numpy(), matrix(rows.column(3))))
                elif members:
                    shard = shard or Shard(np.concatenate([m[0] for m in members]), np.concatenate([m[1] for m in members]), k)
                    waiting.append(rows)
                    if sum(map(len, waiting)) >= BLOCK:
                        yield answered(shard, waiting)
                        waiting = []
        if waiting:
            yield answered(shard, waiting)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest other rows found for each row that ``is_query`` names."""
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable() & F.col("vec_id").isNotNull())
    rows = stored(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("asks").alias("asks")).withColumn("size", F.size("embedding")), "search-vectors")
    dealt = None
    for size, n in rows.groupBy("size").agg(F.count("*")).orderBy("size").collect():
        shards = max(1, -(-n // shard_rows))
        same = rows.where(F.col("size") == size)
        members = same.select(F.lit(size).alias("size"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "vec_id", "embedding")
        every = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
        both = members.union(same.where("asks").select(F.lit(size).alias("size"), F.explode(every).alias("shard"), F.lit(1).alias("kind"), "vec_id", "embedding"))
        dealt = both if dealt is None else dealt.union(both)
    if dealt is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = dealt.select((F.col("size").cast("long") * 2**40 + F.col("shard")).alias("list"), "kind", "vec_id", "embedding")
    found = lists.repartition("list").sortWithinPartitions("list", "kind", "vec_id").mapInArrow(_searched(k, beam), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
