"""Near duplicates of embeddings by an inverted multi-index.

Independent codebooks on the two halves of the unit vectors form a product grid of cells; every vector is in
the cell of its nearest codes. A query orders the codes of each half by distance and merges the two sequences: it
visits the cells in the order of their summed squared distances until the target recall is reached. How many
cells that takes is measured on a sample: for vectors turned by just the threshold's angle (in all directions, and within either half),
and for the sample's own linked pairs, how many cells are nearer than the one that holds the other. What the visited cells hold is compared in single precision, and in
double precision where that leaves a doubt. A pair is linked where either of the two visits the other's cell: with each vector goes the radius of its
walk, so that a task that finds a pair from one side knows whether the other side finds it as well, and counts it for both.

Codes grow with the root of the number of vectors, so that cells keep their size. Cells, in the order of their codes, are dealt to parts of at most
``PART_ROWS`` vectors (a fuller cell to several), and a query is sent to the parts that hold a cell it visits: as many as it visits cells at most, whatever the number of
vectors. Parts that many queries visit are dealt to several tasks by query. A task holds one part, streams its queries, and returns counts and a spanning
set of its links, linear in its rows.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing (0 links,
component is the own vec_id); vectors of different lengths aren't compared. Rows that share vec_id and vector are one vector, each with its row; of several vectors with
one vec_id the least (by components) stands for all. Equal vectors are one node while links are sought. Rows without vec_id take no part, their component is null and they
are kept. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import bound_batches, cut, stored
from larder.llm.components import connected_components

#: Vectors of a cell on average, fewest and most codes of a half, sample rows of a code and of all at least, k-means rounds.
CELL_ROWS, LEAST_CODES, MOST_CODES, CODE_SAMPLE, SAMPLE_ROWS, ROUNDS = 16, 16, 1024, 16, 8192, 12
#: Share of the furthest linked vectors that a walk from one side has to reach, and sample rows that it is measured on.
RECALL, MEASURED = 0.999, 1024
#: Vectors of a part, queries that a task compares with it, queries compared at once, difference that single precision leaves in doubt.
PART_ROWS, TASK_QUERIES, QUERY_ROWS, MARGIN = 4096, 250_000, 512, 1e-4


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector has only finite components, and one that is not 0."""
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def codebook(points: np.ndarray, codes: int) -> np.ndarray:
    """k-means centres of ``points``, from a fixed start, in an order in which neighbours are alike."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.RandomState(7).permutation(len(distinct))[:codes]]
    for _ in range(ROUNDS):
        near = squared(points, centres).argmin(axis=1)
        order = np.argsort(near, kind="stable")
        some, first = np.unique(near[order], return_index=True)
        centres[some] = np.add.reduceat(points[order], first, axis=0) / np.diff(np.append(first, len(points)))[:, None]
    chain, left = [0], np.ones(len(centres), bool)
    left[0] = False
    apart = squared(centres, centres)
    while left.any():
        chain.append(int(np.where(left, apart[chain[-1]], np.inf).argmin()))
        left[chain[-1]] = False
    return centres[chain]


class Grid:
    """The codebooks of both halves and the cells that a walk visits."""

    def __init__(self, known: np.ndarray, codes: int, threshold: float) -> None:
        self.half = known.shape[1] // 2
        self.books = [codebook(known[:, : self.half], codes) if self.half else np.zeros((1, 0)), codebook(known[:, self.half :], codes)]
        self.wide = len(self.books[1])
        self.visits = self._measured(known, threshold)

    @property
    def cells(self) -> int:
        return len(self.books[0]) * self.wide

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.books[0]), squared(x[:, self.half :], self.books[1])

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * self.wide + b.argmin(axis=1)

    def _measured(self, known: np.ndarray, threshold: float) -> int:
        """Cells of a walk that reaches the target recall on the sample."""
        rng = np.random.RandomState(5)
        q = known[rng.permutation(len(known))[:MEASURED]]
        turn = rng.randn(*q.shape)
        kind = np.arange(len(q)) % 3
        turn[kind == 1, : self.half] = 0
        turn[kind == 2, self.half :] = 0
        turn -= (turn * q).sum(axis=1, keepdims=True) * q
        turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
        pairs = [(q, threshold * q + np.sqrt(max(0.0, 1 - threshold**2)) * turn)]
        near = q @ known.T >= threshold
        i, j = np.nonzero(near)
        some = rng.permutation(len(i))[: 4 * MEASURED]
        pairs.append((q[i[some]], known[j[some]]))
        ranks = []
        for x, y in pairs:
            for s in range(0, len(x), 32):
                a, b = self.distances(x[s : s + 32])
                whole, own = (a[:, :, None] + b[:, None, :]).reshape(len(a), -1), self.cell(y[s : s + 32])
                ranks.append((whole < whole[np.arange(len(a)), own][:, None]).sum(axis=1) + 1)
        return max(int(np.ceil(np.quantile(r, RECALL))) for r in (np.concatenate(ranks[: -(-len(q) // 32)]), np.concatenate(ranks)))

    def walk(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each row the radius of its walk and the cells that it visits, by merging the two sequences of codes."""
        a, b = self.distances(x)
        by_a, by_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        a, b = np.take_along_axis(a, by_a, axis=1), np.take_along_axis(b, by_b, axis=1)
        # Whoever is among the nearest has all pairs of nearer codes before it.
        i, j = (v + 1 for v in np.divmod(np.arange(min(len(self.books[0]), self.visits + 1) * self.wide), self.wide))
        front = i * j <= self.visits + 1
        i, j = i[front] - 1, j[front] - 1
        sums = a[:, i] + b[:, j]
        if self.visits >= self.cells:
            radius = np.full(len(x), np.inf)
        else:
            top = np.partition(sums, (self.visits - 1, self.visits), axis=1)
            # Between the last cell visited and the next, so that rounding can't change what is visited.
            radius = (top[:, self.visits - 1] + top[:, self.visits]) / 2
        cells = by_a[:, i] * self.wide + by_b[:, j]
        return radius, [c[s] for c, s in zip(cells, sums <= radius[:, None], strict=True)]


class Parts:
    """How cells are dealt to parts, and parts to tasks."""

    def __init__(self, grid: Grid, rows: dict[int, int], known: np.ndarray, total: int) -> None:
        self.first, self.count = np.zeros(grid.cells, np.int32), np.zeros(grid.cells, np.int32)
        part, held = -1, PART_ROWS
        for cell in sorted(rows):
            if held + rows[cell] > PART_ROWS:
                part, held = part + 1, 0
            need = -(-rows[cell] // PART_ROWS)
            self.first[cell], self.count[cell] = part, need
            part, held = part + need - 1, PART_ROWS if need > 1 else held + rows[cell]
        visits = np.zeros(part + 1)
        for x in np.array_split(known, max(1, len(known) // 64)):
            for cells in grid.walk(x)[1]:
                visits[self.visited(cells)] += total / len(known)
        self.tasks = np.maximum(1, np.ceil(visits / TASK_QUERIES)).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.tasks)))

    def visited(self, cells: np.ndarray) -> np.ndarray:
        """The distinct parts of the cells."""
        count = self.count[cells]
        first = np.repeat(self.first[cells], count)
        return np.unique(first + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count))


_ROUTED = "task long, kind int, cell int, radius double, vec_id long, n long, embedding "


def _spread(ids: np.ndarray, over: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % over.astype(np.uint64)).astype(np.int64)


def _routes(grid: Grid, parts: Parts):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 64):
                some = batch.slice(s, 64)
                ids, x = some.column(0).to_numpy(), unit(matrix(some.column(2)))
                home = grid.cell(x)
                radius, walks = grid.walk(x)
                own = parts.first[home] + _spread(ids, parts.count[home])
                tasks = parts.tasks[own]
                members = np.repeat(np.arange(len(x)), tasks)
                at = parts.starts[own][members] + np.arange(len(members)) - np.repeat(np.cumsum(tasks) - tasks, tasks)
                visited = [parts.visited(c) for c in walks]
                asks = np.repeat(np.arange(len(x)), [len(v) for v in visited])
                there = np.concatenate(visited)
                to = parts.starts[there] + _spread(ids[asks] * 31 + 7, parts.tasks[there])
                for kind, rows, task in ((0, members, at), (1, asks, to)):
                    yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(np.full(len(rows), kind, np.int32)), pa.array(home[rows].astype(np.int32)), pa.array(radius[rows]), *some.take(pa.array(rows)).columns], ["task", "kind", "cell", "radius", "vec_id", "n", "embedding"])

    return run


class _Part:
    """The vectors of a part by cell, and what is linked so far."""

    def __init__(self, grid: Grid, threshold: float, batches: list[pa.RecordBatch]) -> None:
        self.grid, self.threshold = grid, threshold
        rows = pa.Table.from_batches(batches).combine_chunks().sort_by("cell")
        cell, self.radius, self.ids, self.n = (rows.column(c).to_numpy() for c in ("cell", "radius", "vec_id", "n"))
        self.x = unit(matrix(rows.column("embedding").combine_chunks()))
        self.x32 = self.x.astype(np.float32)
        self.cells, first = np.unique(cell, return_index=True)
        self.spans = list(zip(first, np.append(first[1:], len(cell)), strict=True))
        self.label = np.arange(len(cell))
        self.a, self.b = grid.distances(self.x)

    def compare(self, q: pa.RecordBatch) -> pa.RecordBatch:
        """vec_id with links to add, and links (vec_id, other) that connect what the queries connect."""
        radius, ids, n = (q.column(i).to_numpy() for i in (3, 4, 5))
        x = unit(matrix(q.column(6)))
        x32 = x.astype(np.float32)
        i, j = np.divmod(q.column(2).to_numpy(), self.grid.wide)
        ci, cj = np.divmod(self.cells, self.grid.wide)
        a, b = squared(x[:, : self.grid.half], self.grid.books[0][ci]), squared(x[:, self.grid.half :], self.grid.books[1][cj])
        seen = a + b <= radius[:, None]
        mine, theirs = np.zeros(len(ids), np.int64), np.zeros(len(self.ids), np.int64)
        links: list[tuple[int, int]] = []
        for c in np.flatnonzero(seen.any(axis=0)):
            lo, hi = self.spans[c]
            rows = np.flatnonzero(seen[:, c])
            score = x32[rows] @ self.x32[lo:hi].T
            near = (score >= self.threshold - MARGIN) & (ids[rows][:, None] != self.ids[None, lo:hi])
            if not near.any():
                continue
            doubt = np.nonzero(near & (score <= self.threshold + MARGIN))
            step = max(1, 4_000_000 // x.shape[1])
            for s in range(0, len(doubt[0]), step):
                r, m = doubt[0][s : s + step], doubt[1][s : s + step]
                near[r, m] = (x[rows[r]] * self.x[lo + m]).sum(axis=1) >= self.threshold
            mine[rows] += near @ self.n[lo:hi]
            back = self.a[lo:hi][:, i[rows]].T + self.b[lo:hi][:, j[rows]].T <= self.radius[lo:hi]
            theirs[lo:hi] += n[rows] @ (near & ~back)
            for r in np.flatnonzero(near.any(axis=1)):
                found = np.unique(self.label[lo:hi][near[r]])
                for other in found[1:]:
                    links.append((self.ids[other], self.ids[found[0]]))
                    self.label[self.label == other] = found[0]
                links.append((ids[rows[r]], self.ids[found[0]]))
        some, more = np.flatnonzero(mine), np.flatnonzero(theirs)
        who = np.concatenate((ids[some], self.ids[more], np.array([u for u, _ in links], np.int64)))
        count = np.concatenate((mine[some], theirs[more], np.zeros(len(links), np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(who), pa.array(count), pa.array([None] * (len(some) + len(more)) + [int(v) for _, v in links], pa.int64())], ["vec_id", "n", "other"])


def _compared(grid: Grid, threshold: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, part, waiting, size = None, [], None, [], 0
        for batch in batches:
            tasks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, (tasks[1:] != tasks[:-1]) | (kinds[1:] != kinds[:-1])))
            for s, e in zip(starts, np.append(starts[1:], len(tasks)), strict=True):
                if tasks[s] != now:
                    if part and waiting:
                        yield part.compare(pa.concat_batches(waiting))
                    now, members, part, waiting, size = tasks[s], [], None, [], 0
                if kinds[s] == 0:
                    members.append(batch.slice(s, e - s))
                elif members:
                    part = part or _Part(grid, threshold, members)
                    waiting.append(batch.slice(s, e - s))
                    size += e - s
                    if size >= QUERY_ROWS:
                        yield part.compare(pa.concat_batches(waiting))
                        waiting, size = [], 0
        if part and waiting:
            yield part.compare(pa.concat_batches(waiting))

    return run


def _counted(grid: Grid):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, n = np.unique(grid.cell(unit(matrix(batch.column(2)))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(n.astype(np.int64))], ["cell", "n"])

    return run


def index(classes: DataFrame, threshold: float) -> tuple[Grid, Parts]:
    """The grid over ``classes`` (vec_id, n, embedding), vectors of one length, fitted on a sample, and its parts, for which all are counted."""
    total = classes.count()
    codes = int(min(MOST_CODES, max(LEAST_CODES, (total / CELL_ROWS) ** 0.5)))
    sample = classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE_ROWS, CODE_SAMPLE * codes)).select("embedding").toArrow().column(0).combine_chunks()
    known = unit(matrix(sample))
    grid = Grid(known, codes, threshold)
    # One row for each cell that holds any, MOST_CODES squared at most.
    rows = classes.mapInArrow(_counted(grid), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return grid, Parts(grid, {r["cell"]: r["n"] for r in rows}, known[:MEASURED], total)


def routed(classes: DataFrame, grid: Grid, parts: Parts) -> DataFrame:
    """Every vector of ``classes`` once for each task of its part (kind 0) and once for each part it visits (kind 1)."""
    return classes.mapInArrow(_routes(grid, parts), _ROUTED + classes.schema["embedding"].dataType.simpleString())


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding)."""
    bound_batches(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    takes_part = usable() & F.col("vec_id").isNotNull()
    one = vectors.where(takes_part).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    one = stored(one.select("vec_id", "embedding", F.size("embedding").alias("size"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")), "embedding-vectors")
    classes = stored(one.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "embedding")).alias("v"), F.count("*").alias("n")).select("h1", "h2", F.col("v.vec_id").alias("vec_id"), "n", F.col("v.embedding").alias("embedding")), "embedding-classes")
    found = classes.sparkSession.createDataFrame([], "vec_id long, n long, other long")
    for size in [r["size"] for r in one.select("size").distinct().orderBy("size").collect()]:
        same = classes.where(F.size("embedding") == size).select("vec_id", "n", "embedding")
        grid, parts = index(same, threshold)
        compared = routed(same, grid, parts).repartition("task").sortWithinPartitions("task", "kind").mapInArrow(_compared(grid, threshold), "vec_id long, n long, other long")
        found = found.union(cut(compared))
    counts = found.where("other is null").groupBy("vec_id").agg(F.sum("n").alias("links"))
    comps = connected_components(found.where("other is not null"), "vec_id", "other").withColumnRenamed("node", "vec_id")
    summary = classes.join(counts, "vec_id", "left").join(comps, "vec_id", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    by_id = one.join(summary, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    joined = vectors.where(takes_part).select("vec_id").join(by_id, "vec_id").select("vec_id", "n_links", "component_id", (F.col("component_id") == F.col("vec_id")).alias("kept"))
    return joined.union(vectors.where(~takes_part).select("vec_id", F.lit(0).cast("long"), "vec_id", F.lit(True)))
