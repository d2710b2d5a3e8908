"""Embedding whitening by hierarchical SVD merging.

Every task sums its vectors up as a state: their number, their exact sums, their mean, and the singular values and right singular
vectors of the centred rows, all dimensions kept. Two states merge by stacking both scaled bases and one row, the
difference of the means times sqrt(a * b / (a + b)), and decomposing the stack anew: nothing is lost, as the scatter of
the union is that of the parts and of their means. Tasks merge batch by batch, then states meet in a tree of ``FAN`` at
a time, so that no task holds more than two states and the driver sees the last one only (dimensions squared).

No covariance matrix is formed, so the singular values have full precision; vectors are centred before they are multiplied.

Defined results: rows whose vector is null, or holds a null or non-finite entry, or one that times 64 is 2^52 or more (its whole number
would not be exact), are left out; vectors of another length are whitened apart, each length as a table of its own; empty vectors have no component and so no row. The fit list
has each distinct vector once, so copies and hot vectors have no weight; partial aggregation takes them before the shuffle. Repeated rows have their own
results. A component without variance has a null ``whitened``, as its scale is undefined, and takes no part in ``identity_error``; where all vectors
are equal ``explained`` is null too. Equal eigenvalues leave the choice of their components to the decomposition; a component's sign
makes its largest entry positive. A deviation beyond a long is null. An empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import bound_batches, stored

#: Components that are returned at most.
MOST = 16
#: States that one task of the tree merges.
FAN = 8
#: Share of the largest singular value below which a component counts as without variance.
FLAT = 1e-12
SCALE, SHIFT, LIMIT = 64, 1_000_000, float(2**52)
_STATE = "dim int, part long, n long, sums array<string>, mean array<double>, s array<double>, vt array<double>"
_MOMENTS = "dim int, part long, n long, mean array<double>, scatter array<double>"


@dataclass
class State:
    """What is kept of a set of vectors: number, exact sums, mean, singular values and right vectors (a row each) of the centred rows."""

    n: int
    sums: list[int]
    mean: np.ndarray
    s: np.ndarray
    vt: np.ndarray


def leaf(x: np.ndarray) -> State:
    """The state of integer rows; their exact mean is taken off before anything is multiplied."""
    n, sums = len(x), [int(v) for v in x.astype(object).sum(axis=0)] if np.abs(x).max() > 2**40 else x.sum(axis=0).tolist()
    low = np.array([v // n for v in sums])
    rest = np.array([(v - int(q) * n) / n for v, q in zip(sums, low, strict=True)])
    _, s, vt = _svd((x - low).astype(float) - rest, x.shape[1])
    return State(n, sums, low + rest, s, vt)


def _svd(rows: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``dim`` singular values and right vectors, also of fewer rows."""
    if len(rows) < dim:
        rows = np.vstack([rows, np.zeros((dim - len(rows), dim))])
    return np.linalg.svd(rows, full_matrices=False)


def merge(a: State, b: State) -> State:
    """The state of both sets together; the mean-correction row makes it exact."""
    n = a.n + b.n
    correction = np.sqrt(a.n * b.n / n) * (a.mean - b.mean)
    _, s, vt = _svd(np.vstack([a.s[:, None] * a.vt, b.s[:, None] * b.vt, correction[None, :]]), len(a.mean))
    return State(n, [x + y for x, y in zip(a.sums, b.sums, strict=True)], a.mean + (b.mean - a.mean) * (b.n / n), s, vt)


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, dim and x, the whole numbers of each vector that has any."""
    entry = lambda c: c.cast("double")
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: F.coalesce(F.abs(entry(c)) * SCALE < LIMIT, F.lit(False)))
    x = F.transform("embedding", lambda c: F.floor(entry(c) * SCALE) + SHIFT)
    return embeddings.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), x.cast("array<long>").alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """The rows of each dimension in a batch as a matrix."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            rows = batch.filter(pa.array(dims == dim))
            yield int(dim), rows.column("x").flatten().to_numpy().reshape(-1, dim), rows


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state for each dimension in the task; rows wait until they are four times as many as dimensions."""
    states: dict[int, State] = {}
    waiting: dict[int, list[np.ndarray]] = {}

    def settle(dim: int) -> None:
        made = leaf(np.vstack(waiting.pop(dim)))
        states[dim] = merge(states[dim], made) if dim in states else made

    for dim, x, _ in _matrices(batches):
        waiting.setdefault(dim, []).append(x)
        if sum(map(len, waiting[dim])) >= max(1024, 4 * dim):
            settle(dim)
    for dim in list(waiting):
        settle(dim)
    for dim, a in states.items():
        yield _record(dim, a)


def _record(dim: int, a: State) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([a.n], pa.int64()), pa.array([[str(v) for v in a.sums]]), pa.array([a.mean.tolist()]), pa.array([a.s.tolist()]), pa.array([a.vt.ravel().tolist()])], ["dim", "n", "sums", "mean", "s", "vt"])


def _state(row) -> State:  # noqa: ANN001
    dim = len(row.mean)
    return State(int(row.n), [int(v) for v in row.sums], np.array(row.mean), np.array(row.s), np.array(row.vt).reshape(dim, dim))


def _merged_states(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    parts = rows.itertuples()
    a = _state(next(parts))
    for row in parts:
        a = merge(a, _state(row))
    return pd.DataFrame({"dim": [rows.dim.iloc[0]], "part": [rows.part.iloc[0] // FAN], "n": [a.n], "sums": [[str(v) for v in a.sums]], "mean": [a.mean], "s": [a.s], "vt": [a.vt.ravel()]})


def tree(states: DataFrame, merged: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One row for each dim, from rows numbered by ``part``, ``FAN`` rows to a task in each round."""
    most = states.agg(F.max("part").alias("m")).first()["m"]
    while most:
        states, most = states.groupBy("dim", F.expr(f"part div {FAN}").alias("group")).applyInPandas(merged, schema), most // FAN
    return states


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.spark_partition_id().cast("long"))


@dataclass
class Model:
    """What whitening a vector of one length needs."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    scales: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None


def fit(vectors: DataFrame) -> dict[int, Model]:
    """The model by dimension of a list of distinct vectors (dim, x)."""
    leaves = vectors.select("dim", "x").mapInArrow(_states, _STATE.replace(" part long,", ""))
    states = stored(_numbered(leaves).select(*[c.split()[0] for c in _STATE.split(", ")]), "whitening-states")
    models = {}
    # One row a dimension, each of dimension squared: the model itself.
    for row in tree(states, _merged_states, _STATE).collect():
        a = _state(row)
        variances = a.s**2 / a.n
        vt = a.vt[:MOST] * np.sign(a.vt[np.arange(min(MOST, len(a.vt))), np.abs(a.vt[:MOST]).argmax(axis=1)])[:, None]
        scales = np.where(a.s[:MOST] > FLAT * max(a.s[0], 1e-300) * len(a.s), np.sqrt(variances[:MOST]), np.nan)
        models[row.dim] = Model(a.n, a.sums, vt, scales, (variances[:MOST] / variances.sum()).tolist() if variances.sum() > 0 else [None] * len(vt))
    return models


def deviations(x: np.ndarray, model: Model) -> np.ndarray:
    """n*x - S, exact: as objects where 64 bits may not hold it."""
    fits = max(int(np.abs(x).max(initial=0)) * model.n, *map(abs, model.sums)) < 2**62
    return x * model.n - np.array(model.sums) if fits else x.astype(object) * model.n - np.array(model.sums, object)


def whitened(off: np.ndarray, model: Model) -> np.ndarray:
    """Rows of deviations as whitened components; NaN for those without variance."""
    return (off / model.n).astype(float) @ model.vectors.T / model.scales


def _moments(models: dict[int, Model]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for dim, x, _ in _matrices(batches):
            w = whitened(deviations(x, models[dim]), models[dim])
            mean = w.mean(axis=0)
            made = (len(w), mean, (w - mean).T @ (w - mean))
            found[dim] = _joined(found[dim], made) if dim in found else made
        for dim, (n, mean, scatter) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([scatter.ravel().tolist()])], ["dim", "n", "mean", "scatter"])

    return run


def _joined(a: tuple, b: tuple) -> tuple:
    n, off = a[0] + b[0], b[1] - a[1]
    return n, a[1] + off * (b[0] / n), a[2] + b[2] + np.outer(off, off) * (a[0] * b[0] / n)


def _joined_moments(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    made = None
    for row in rows.itertuples():
        one = (int(row.n), np.array(row.mean), np.array(row.scatter).reshape(len(row.mean), -1))
        made = one if made is None else _joined(made, one)
    return pd.DataFrame({"dim": [rows.dim.iloc[0]], "part": [rows.part.iloc[0] // FAN], "n": [made[0]], "mean": [made[1]], "scatter": [made[2].ravel()]})


def measure(vectors: DataFrame, models: dict[int, Model]) -> None:
    """Set each model's identity_error: the largest entry of the whitened vectors' covariance less the identity."""
    moments = _numbered(vectors.select("dim", "x").mapInArrow(_moments(models), _MOMENTS.replace(" part long,", "")))
    moments = stored(moments.select(*[c.split()[0] for c in _MOMENTS.split(", ")]), "whitening-moments")
    for row in tree(moments, _joined_moments, _MOMENTS).collect():
        covariance = np.array(row.scatter).reshape(len(row.mean), -1) / row.n
        off = np.abs(covariance - np.eye(len(row.mean)))
        models[row.dim].identity_error = float(np.nanmax(off)) if not np.isnan(off).all() else None


def _whitened_rows(models: dict[int, Model]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, x, rows in _matrices(batches):
            m = models[dim]
            off, k = deviations(x, m), len(m.vectors)
            far = off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * dim < 2**63
            total = (off * off).sum(axis=1).tolist() if far else [v if (v := sum(int(c) ** 2 for c in r)) < 2**63 else None for r in off.tolist()]
            values = whitened(off, m).ravel()
            size, each = len(x), np.tile(np.arange(k), len(x))
            ids, deviation = np.repeat(np.arange(size), k), pa.array(total, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows.column("vec_id").take(pa.array(ids)), pa.array(each + 1, pa.int32()), pa.array(np.full(size * k, m.n), pa.int64()), deviation.take(pa.array(ids)),
                 pa.array(values, pa.float64(), mask=np.isnan(values)), pa.array([m.explained[i] for i in each], pa.float64()), pa.array([m.identity_error] * (size * k), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(embeddings: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each usable row and component."""
    bound_batches(embeddings.sparkSession)
    rows = whole_vectors(embeddings)
    distinct = stored(rows.select("dim", "x").distinct(), "whitening-vectors")
    models = fit(distinct)
    measure(distinct, models)
    return rows.mapInArrow(_whitened_rows(models), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
