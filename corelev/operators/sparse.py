"""Wide and sparse designs (A5, C1, C2, C7, E6, E8, E9): rows (id, y, w, idx ARRAY<INT>, val ARRAY<DOUBLE>), never densified.

Every operator works on the non-zeros of an Arrow batch, a flat pair of arrays with row offsets. Vectors of
length d are the largest thing a task or the driver holds, but for ``gram``, which is d x d by its result.
The fit is a limited-memory quasi-Newton: a pass over the rows gives the loss and one d-vector, whose partial
sums are added on the executors in pieces; the driver keeps ``MEMORY`` pairs of d-vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pnormal as PN
from ..functions import random as R
from .linalg import basis_from_gram
from .probit import FitResult

MEMORY = 10       # pairs of the quasi-Newton matrix
PIECE = 8192      # entries of a d-vector that are summed together
FAN = 32          # partial vectors added in one task


def sparse_rows(df: DataFrame, col: str = "x") -> DataFrame:
    """Dense rows as sparse ones: the places (from 0) and values of all non-zero entries."""
    pairs = F.filter(F.transform(col, lambda v, i: F.struct(i.alias("i"), v.cast("double").alias("v"))), lambda e: e["v"] != 0)
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, pairs.alias("_p")).select(*keep, F.col("_p.i").alias("idx"), F.col("_p.v").alias("val"))


def width(df: DataFrame) -> int:
    top = df.agg(F.max(F.array_max("idx"))).first()[0]
    return 0 if top is None else int(top) + 1


def _parts(batch: pa.RecordBatch):
    """(row of each non-zero, place, value) of a batch."""
    idx, val = batch.column("idx"), batch.column("val")
    n = idx.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), n)
    return row, idx.flatten().to_numpy(zero_copy_only=False), val.flatten().to_numpy(zero_copy_only=False).astype(float)


def _summed(parts: DataFrame) -> DataFrame:
    """(piece, part, v) partial vectors -> (piece, v) their sums, ``FAN`` at a time within a task, then those."""
    def add(key, t):
        v = t["v"].combine_chunks()
        size = len(v[0])
        total = v.flatten().to_numpy().reshape(-1, size).sum(axis=0)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total], pa.list_(pa.float64()))})

    one = parts.groupBy("piece", F.pmod("part", F.lit(FAN)).alias("to")).applyInArrow(add, "piece int, v array<double>")
    return one.groupBy("piece").applyInArrow(add, "piece int, v array<double>")


def _pieces(vector: np.ndarray, part: int):
    for k, a in enumerate(range(0, len(vector), PIECE)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([vector[a:a + PIECE]], pa.list_(pa.float64()))],
                                         names=["piece", "part", "v"])


def loss_gradient(df: DataFrame, beta: np.ndarray, p: float = 2.0, tail: str = "exact") -> tuple[float, np.ndarray, int]:
    """(f, gradient, rows) of sum w g(-y x.beta) in one pass; the driver gets d numbers."""
    d = len(beta)
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(beta, dtype=float))

    def run(batches):
        from pyspark import TaskContext

        b, out, f, n = shared.value, np.zeros(d), 0.0, 0
        for batch in batches:
            row, idx, val = _parts(batch)
            y, w = batch.column("y").to_numpy().astype(float), batch.column("w").to_numpy().astype(float)
            g, gp, _ = PN.np_loss_grad_hess(-y * np.bincount(row, val * b[idx], batch.num_rows), p, tail)
            f, n = f + float(np.sum(w * g)), n + batch.num_rows
            out += np.bincount(idx, (-w * gp * y)[row] * val, d)
        if n:
            yield from _pieces(np.r_[f, n, out], TaskContext.get().partitionId())

    sums = _summed(df.select("y", "w", "idx", "val").mapInArrow(run, "piece int, part int, v array<double>"))
    got = {r["piece"]: r["v"] for r in sums.toLocalIterator()}
    shared.destroy()
    if not got:
        return 0.0, np.zeros(d), 0
    v = np.concatenate([got[k] for k in sorted(got)])
    return float(v[0]), v[2:], int(v[1])


def lbfgs(evaluate, d: int, max_iter: int = 200, tol: float = 1e-7, memory: int = MEMORY) -> FitResult:
    """Minimum of a smooth convex function from 0 by L-BFGS with a Wolfe line search; evaluate(beta) -> (f, gradient, n).

    The next direction comes from the last ``memory`` steps and changes of the gradient; a step is taken when it
    lessens f enough and the slope has flattened (bisection between the bounds seen). Ends when the largest entry
    of the gradient is below ``tol`` a row.
    """
    beta = np.zeros(d)
    f, g, n = evaluate(beta)
    pairs, it = [], 0
    while it < max_iter and n and np.max(np.abs(g)) / n > tol:
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            alphas.append((s @ q) / (s @ y))
            q -= alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(pairs, reversed(alphas)):
            q += (a - (y @ q) / (s @ y)) * s
        slope = -(g @ q)
        lo, hi, step = 0.0, np.inf, 1.0
        for _ in range(30):
            new = beta - step * q
            f2, g2, _ = evaluate(new)
            if not np.isfinite(f2) or f2 > f + 1e-4 * step * slope + 1e-12 * abs(f):
                hi = step
            elif -(g2 @ q) < 0.9 * slope:
                lo = step
            else:
                break
            step = 2 * lo if np.isinf(hi) else 0.5 * (lo + hi)
        s, y = new - beta, g2 - g
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs = [*pairs, (s, y)][-memory:]
        moved = np.max(np.abs(s)) if d else 0.0
        beta, f, g, it = new, f2, g2, it + 1
        if moved == 0.0:
            break
    return FitResult(beta, f, g, it, bool(n and np.max(np.abs(g)) / n <= max(tol, 1e-5)), n)


def fit(df: DataFrame, p: float = 2.0, d: int | None = None, tail: str = "exact", max_iter: int = 200) -> FitResult:
    """E8/E9 for wide designs: the optimum of ``probit.fit`` from d-vectors only (no d x d matrix anywhere).

    The rows are kept in memory and on disk while they are read again, twice a step or so.
    """
    d = width(df) if d is None else d
    rows = df.select("y", "w", "idx", "val").persist(StorageLevel.MEMORY_AND_DISK)
    labels = {r["y"] for r in rows.select("y").distinct().limit(4).collect()}
    if labels != {-1, 1}:
        rows.unpersist()
        raise ValueError("labels must be -1 and 1, and both must occur")
    try:
        return lbfgs(lambda b: loss_gradient(rows, b, p, tail), d, max_iter)
    finally:
        rows.unpersist()


def countsketch(df: DataFrame, s: int, seed: int = 0, stream: str = "cs") -> DataFrame:
    """C2 on non-zeros: (bucket, j, value) of the cells that any row reaches, a partial and a final sum."""
    b, sg = R.bucket("id", s, seed, stream + ":f"), R.sign("id", seed, stream + ":g")
    cell = F.explode(F.arrays_zip("idx", "val"))
    return (df.select(b.alias("bucket"), sg.alias("sg"), cell.alias("c"))
            .groupBy("bucket", F.col("c.idx").alias("j")).agg(F.sum(F.col("sg") * F.col("c.val")).alias("value")))


def gram(df: DataFrame, d: int) -> np.ndarray:
    """X^T X from the pairs of non-zeros of each row; d x d numbers in every task and on the driver."""
    def run(batches):
        from pyspark import TaskContext

        G, any_row = np.zeros(d * d), False
        for batch in batches:
            row, idx, val = _parts(batch)
            any_row |= batch.num_rows > 0
            n = np.bincount(row, minlength=batch.num_rows)
            first = np.cumsum(n) - n
            step = max(1, int(np.searchsorted(np.cumsum(n * n), 4_000_000))) if len(n) else 1
            for a in range(0, batch.num_rows, step):
                rows = slice(a, a + step)
                m, at = n[rows], first[rows]
                left = np.repeat(np.arange(at[0], at[0] + m.sum()), np.repeat(m, m))
                ends = np.cumsum(np.repeat(m, m))
                right = np.arange(len(left)) - np.repeat(ends - np.repeat(m, m), np.repeat(m, m)) + np.repeat(np.repeat(at, m), np.repeat(m, m))
                G += np.bincount(idx[left] * np.int64(d) + idx[right], val[left] * val[right], d * d)
        if any_row:
            yield from _pieces(G, TaskContext.get().partitionId())

    got = {r["piece"]: r["v"] for r in _summed(df.select("idx", "val").mapInArrow(run, "piece int, part int, v array<double>")).collect()}
    return np.concatenate([got[k] for k in sorted(got)]).reshape(d, d) if got else np.zeros((d, d))


def row_norms(df: DataFrame, M: np.ndarray, out: str = "score", power: float = 2.0) -> DataFrame:
    """``df`` with ``out`` = ||x^T M||_2^power from the non-zeros of each row and the rows of M they pick."""
    shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(M))
    keep = [c for c in df.columns if c != out]
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            row, idx, val = _parts(batch)
            sums = np.zeros((batch.num_rows, M.shape[1]))
            for k in range(M.shape[1]):
                sums[:, k] = np.bincount(row, val * shared.value[idx, k], batch.num_rows)
            score = np.sqrt(np.einsum("ij,ij->i", sums, sums)) ** power
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], names=[*keep, out])

    return df.select(*keep).mapInArrow(run, f"{types}, `{out}` double")


def leverage_scores(df: DataFrame, d: int | None = None, out: str = "score") -> DataFrame:
    """C7 on non-zeros (p = 2): ||Q_i||^2 by the Gram's basis, zero for columns that no row has."""
    d = width(df) if d is None else d
    return row_norms(df, basis_from_gram(gram(df, d), prefer="eigh"), out)
