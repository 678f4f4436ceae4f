"""Whitening of embeddings by shifted CholeskyQR.

A vector's entries c become whole numbers x = floor(256 c). The model is fitted on each distinct x-vector once. Its centred rows X are
made orthogonal again and again: a pass over the rows adds up the Gram matrix of X times the inverses of the factors found so
far (each a triangular solve), the driver takes its Cholesky factor, and the factors multiply to R. The first Gram matrix, and any that is
nearly singular, gets a shift on its diagonal before it is factored, so that the factor exists however badly scaled or dependent the dimensions
are. When the Gram matrix of the rows is the identity (or on dependent dimensions zero), X has the singular values and right singular vectors of R: its SVD gives
the components, and their squares over n the eigenvalues of the covariance. What the last Gram matrix G still lacks is put right by sqrt(G) R.

Rows meet in one shuffle, that for the distinct vectors, which carries them as packed whole numbers of the least width and counts repeats
before it shuffles. All else are passes over written rows: a task gives one matrix of d x d numbers, whose lines are added up by line over the tasks, so the driver sees d x d numbers, whatever
the number of rows. What is sent to the tasks are factors of that size.

Defined cases: a row is dropped whose vector is null, has a null or non-finite entry or one whose x is no long, has no entries, or another
length than most (of equals the greater length); an empty table, or one with a single distinct vector, has no components and gives no rows; components whose eigenvalue is no more
than rounding (dependent dimensions) are left out; the sign of a component is that which makes its largest entry positive; `deviation` is null where it doesn't fit
a long; null and repeated vec_ids give their rows like others; further columns are ignored. Very long vectors are worked through some rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

COMPONENTS = 4
SCALE = 256
#: Passes at most, and how far from orthogonal the rows may be to stop.
PASSES, CLOSE = 5, 1e-10
#: Numbers that are worked on at once.
ENTRIES = 1 << 20
EPS = float(np.finfo(np.float64).eps)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, d and x of each row whose vector is whole; x: whole numbers of 1, 2, 4 or 8 bytes, the fewest that hold them all."""
    for batch in batches:
        ids, dims, xs = [], [], []
        start = 0
        length = pc.fill_null(pc.list_value_length(batch["v"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(length) // ENTRIES
        for rows in np.split(np.arange(len(length)), np.flatnonzero(np.diff(part)) + 1) if len(length) else ():
            own = batch.slice(int(rows[0]), len(rows))
            with np.errstate(all="ignore"):
                x = np.floor(SCALE * own["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                bad = np.r_[0, np.cumsum(~(np.abs(x) < 2.0**63))]
                x = np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64)
            end = np.cumsum(length[rows])
            start = end - length[rows]
            for i in np.flatnonzero((length[rows] > 0) & (bad[end] == bad[start])):
                row = x[start[i] : end[i]]
                most = max(int(row.max()), ~int(row.min()))
                width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w - 1)
                ids.append(own["vec_id"][int(i)].as_py())
                dims.append(len(row))
                xs.append(row.astype(f"<i{width}").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(xs, pa.binary())], names=["vec_id", "d", "x"])


def unpacked(batch: pa.RecordBatch, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a batch: the place of the first row, and the rows as whole numbers."""
    step = max(1, ENTRIES // d)
    for at in range(0, batch.num_rows, step):
        rows = batch["x"].slice(at, step).to_pylist()
        if len({len(r) for r in rows}) == 1:
            yield at, np.frombuffer(b"".join(rows), dtype=f"<i{len(rows[0]) // d}").reshape(-1, d).astype(np.int64)
        else:
            yield at, np.stack([np.frombuffer(r, dtype=f"<i{len(r) // d}").astype(np.int64) for r in rows])


def summed(fit: DataFrame, d: int, lines: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of `of`, which gives so many lines of numbers for some rows of x. Each task adds up its own, then each line is added up over the tasks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in unpacked(batch, d):
                total = of(x) if total is None else total + of(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(lines), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["line", "v"])

    def add(group: pa.Table) -> pa.Table:
        width = len(group["v"][0])
        total = np.zeros(width)
        for chunk in group["v"].chunks:
            total += chunk.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).sum(axis=0)
        return pa.table({"line": group["line"].slice(0, 1), "v": pa.array([total], pa.list_(pa.float64()))})

    added = fit.select("x").mapInArrow(part, "line int, v array<double>").groupBy("line").applyInArrow(add, "line int, v array<double>")
    return np.array([v for _, v in sorted((r["line"], r["v"]) for r in added.collect())])


@dataclass(frozen=True)
class Centre:
    """n rows and their sums by dimension, exact."""

    n: int
    sums: list[int]

    def times_n(self, x: np.ndarray) -> np.ndarray | None:
        """n * x - sums, exact, or None where that could leave 62 bits."""
        most = self.n * max(1, int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.sums))
        return None if most >= 1 << 62 else x * self.n - np.array(self.sums, dtype=np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        exact = self.times_n(x)
        return x - np.array([s / self.n for s in self.sums]) if exact is None else exact / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of the squares of n * x - sums; None where that is no long."""
        exact = self.times_n(x)
        if exact is not None and x.shape[1] * float(np.abs(exact).max(initial=0)) ** 2 < 2.0**62:
            return (exact * exact).sum(axis=1).tolist()
        whole = [sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in whole]


def centre_of(fit: DataFrame, d: int) -> Centre:
    """Counts and sums. Numbers are added in pieces of 16 bits, so that no sum is rounded (up to 2^37 rows)."""

    def pieces(x: np.ndarray) -> np.ndarray:
        return np.stack([np.full(x.shape[1], len(x)), *((x >> b & 0xFFFF).sum(axis=0) for b in (0, 16, 32)), (x >> 48).sum(axis=0)]).astype(np.float64)

    total = summed(fit, d, 5, pieces)
    if not total.size:
        return Centre(0, [])
    n, *parts = ([int(v) for v in line] for line in total)
    return Centre(n[0], [sum(p << 16 * i for i, p in enumerate(x)) for x in zip(*parts)])


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverse of each upper triangular factor, one after another."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(len(r)):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def factored(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """The upper triangular Cholesky factor of the Gram matrix, shifted in the first pass and where it is nearly singular."""
    d, values = len(gram), np.linalg.eigvalsh(gram)
    shift = 11 * (n * d + d * (d + 1)) * EPS / 2 * values[-1]
    # a row count beyond some billions would make the bound on rounding larger than the matrix
    shift = min(shift, 1e-6 * values[-1])
    if not first and values[0] > 1e-8 * values[-1]:
        return np.linalg.cholesky(gram).T
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


@dataclass(frozen=True)
class Whitening:
    """What fit() finds: `axes` holds a component over the root of its eigenvalue in each column."""

    d: int
    centre: Centre
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int


def fit_on(fit: DataFrame, d: int, components: int = COMPONENTS, passes: int = PASSES) -> Whitening | None:
    """The model of the distinct vectors, column x, of d dimensions; None without any spread."""
    centre = centre_of(fit, d)
    if not centre.n:
        return None
    factors: list[np.ndarray] = []
    whole = np.eye(d)

    def gram_of(x: np.ndarray) -> np.ndarray:
        q = solved(centre(x), factors)
        return q.T @ q

    for k in range(passes):
        gram = summed(fit, d, d, gram_of)
        gram = (gram + gram.T) / 2
        if not np.trace(gram) > 0:
            return None
        values = np.linalg.eigvalsh(gram)
        if factors and (np.minimum(np.abs(values - 1), np.abs(values)) < CLOSE).all() or k == passes - 1:
            break
        factors = [*factors, factored(gram, centre.n, k == 0)]
        whole = factors[-1] @ whole
    g, w = np.linalg.eigh(gram)
    _, singular, vt = np.linalg.svd(np.sqrt(np.maximum(g, 0))[:, None] * (w.T @ whole))
    values = singular**2 / centre.n
    rank = int((singular > max(d, 100) * EPS * singular[0]).sum())
    m = min(components, rank)
    vt = vt[:m] * np.where(vt[np.arange(m), np.abs(vt[:m]).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    axes = vt.T / np.sqrt(values[:m])

    def second(x: np.ndarray) -> np.ndarray:
        y = centre(x) @ axes
        return np.vstack([y.T @ y, y.sum(axis=0)])

    moments = summed(fit, d, m + 1, second) / centre.n
    error = np.abs(moments[:m] - np.outer(moments[m], moments[m]) - np.eye(m)).max()
    return Whitening(d, centre, values[:m], axes, values[:m] / values.sum(), float(error), len(factors) + 1)


def rows_of(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x: packed whole numbers) of the rows that are kept, written down, and their number of dimensions (0: there are no rows)."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    rows = durable(given.mapInArrow(packed, "vec_id long, d int, x binary"))
    most = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    return rows.where(F.col("d") == d).select("vec_id", "x"), d


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """SCHEMA: a row for each of rows (vec_id, x) and component, numbered from 1."""
    m = len(model.values)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in unpacked(batch, model.d):
                each = np.repeat(np.arange(len(x)), m)
                of_row = [batch["vec_id"].slice(at, len(x)).take(pa.array(each)), pa.array(model.centre.deviation(x), pa.int64()).take(pa.array(each))]
                of_component = [np.tile(v, len(x)) for v in (np.arange(1, m + 1, dtype=np.int32), model.explained, model.values)]
                columns = [of_row[0], of_component[0], np.full(len(each), model.centre.n), of_row[1], (model.centre(x) @ model.axes).ravel(), of_component[1], np.full(len(each), model.identity_error), of_component[2]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return rows.mapInArrow(run, SCHEMA)


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The vectors' whitened components: SCHEMA, fitted on the distinct vectors among them."""
    rows, d = rows_of(vectors, column)
    model = fit_on(durable(rows.select("x").distinct()), d, components) if d else None
    return whitened(rows, model) if model else vectors.sparkSession.createDataFrame([], SCHEMA)
