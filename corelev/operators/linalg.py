"""d x d driver algebra and per-row linear maps.

Only d x d (or sketch-size x d) matrices live on the driver. Per-row products
``x^T M`` are applied back on the executors: as native column expressions with
literal coefficients for small d, as an Arrow-batched numpy matmul otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .moments import NATIVE_MAX_D, _batch_matrix


def basis_from_gram(G: np.ndarray, rtol: float = 1e-12, prefer: str = "chol") -> np.ndarray:
    """M (d x r) with M^T G M = I_r, i.e. Q = X M has orthonormal columns.

    Full rank: M = R^{-1} from the Cholesky factor (R equals the QR factor of X
    up to column signs, so p-norms of Q rows match a QR basis). Rank deficient:
    eigen-basis with eigenvalues above rtol * max, i.e. leverage by pseudo-inverse.
    """
    G = 0.5 * (G + G.T)
    if prefer == "chol":
        try:
            L = np.linalg.cholesky(G)
            R = L.T
            diag = np.abs(np.diag(R))
            if diag.min() > np.sqrt(rtol) * diag.max():
                return np.linalg.inv(R)
        except np.linalg.LinAlgError:
            pass
    lam, V = np.linalg.eigh(G)
    keep = lam > rtol * max(lam.max(), 0.0)
    if not keep.any():
        return np.zeros((G.shape[0], 1))
    return V[:, keep] / np.sqrt(lam[keep])


def basis_from_r(R: np.ndarray, rtol: float = 1e-12) -> np.ndarray:
    """M with Q = X M orthonormal from X's triangular factor: R^{-1}, or by its SVD when X is rank deficient."""
    _, sv, Vt = np.linalg.svd(R)
    keep = sv > rtol * max(sv.max(initial=0.0), 0.0)
    if keep.all():
        return np.linalg.inv(R)
    return Vt[keep].T / sv[keep] if keep.any() else np.zeros((R.shape[1], 1))


def tsqr(df: DataFrame, d: int, col: str = "x", fan: int = 32) -> np.ndarray:
    """Triangular factor of the n x d matrix by a tree of QRs (condition number not squared).

    Every partition reduces its rows to one d x d factor, ``fan`` factors at a time are stacked
    and factored again until few are left; the diagonal is made non-negative.
    """
    import pandas as pd

    def small(rows):
        R = np.linalg.qr(rows, mode="r")
        return R if R.shape[0] == d else np.vstack([R, np.zeros((d - R.shape[0], d))])

    def part(batches):
        from pyspark import TaskContext

        R = None
        for b in batches:
            if b.num_rows:
                X = _batch_matrix(b, col, d)
                R = small(X if R is None else np.vstack([R, X]))
        if R is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([R.ravel().tolist()], pa.list_(pa.float64()))], names=["part", "r"])

    def merge(pdf: "pd.DataFrame") -> "pd.DataFrame":
        R = small(np.vstack([np.asarray(r, float).reshape(d, d) for r in pdf["r"]]))
        return pd.DataFrame({"part": [int(pdf["part"].iat[0]) // fan], "r": [R.ravel().tolist()]})

    parts = df.select(F.col(col).alias(col)).mapInArrow(part, "part BIGINT, r ARRAY<DOUBLE>").persist()
    cached = parts
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while left > fan:
        parts = parts.groupBy(F.floor(F.col("part") / fan)).applyInPandas(merge, "part BIGINT, r ARRAY<DOUBLE>")
        left = -(-left // fan)
    rows = [np.asarray(r["r"], float).reshape(d, d) for r in parts.orderBy("part").collect()]
    cached.unpersist()
    R = small(np.vstack(rows)) if rows else np.zeros((d, d))
    return np.where(np.diag(R) < 0, -1.0, 1.0)[:, None] * R


def project_cols(x: Column, M: np.ndarray) -> list:
    """Native expressions q_k = sum_j x[j] M[j,k] for each column k of M."""
    d, r = M.shape
    out = []
    for k in range(r):
        terms = [x[j] * F.lit(float(M[j, k])) for j in range(d) if M[j, k] != 0.0]
        acc = terms[0] if terms else F.lit(0.0)
        for t in terms[1:]:
            acc = acc + t
        out.append(acc)
    return out


def row_norm_expr(x: Column, M: np.ndarray, p: float = 2.0, power: bool = True) -> Column:
    """||x^T M||_p^p (power=True) or ||x^T M||_p, as a native expression."""
    qs = project_cols(x, M)
    if p == 2.0:
        parts = [q * q for q in qs]
    else:
        parts = [F.pow(F.abs(q), F.lit(float(p))) for q in qs]
    acc = parts[0]
    for t in parts[1:]:
        acc = acc + t
    if power:
        return acc
    return F.sqrt(acc) if p == 2.0 else F.pow(acc, F.lit(1.0 / p))


def with_row_norm(df: DataFrame, M: np.ndarray, out: str, p: float = 2.0, power: bool = True,
                  col: str = "x", scale: Column | None = None) -> DataFrame:
    """Append ``out`` = ||scale * x^T M||_p^p for every row.

    Small d: native column expression. Large d: Arrow batch matmul.
    """
    d = M.shape[0]
    if d <= NATIVE_MAX_D and M.shape[1] <= 32:
        e = row_norm_expr(F.col(col), M, p, power)
        if scale is not None:
            e = e * (F.pow(scale, F.lit(p)) if power else scale)
        return df.withColumn(out, e)
    Mc = np.ascontiguousarray(M)
    schema = df.schema
    tmp_scale = "__scale"
    src = df.withColumn(tmp_scale, scale.cast("double") if scale is not None else F.lit(1.0))
    from pyspark.sql.types import DoubleType, StructField, StructType

    out_schema = StructType(list(schema.fields) + [StructField(out, DoubleType())])
    xi = src.columns.index(col)
    si = src.columns.index(tmp_scale)
    keep = [i for i, c in enumerate(src.columns) if c != tmp_scale]

    def part(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            X = _batch_matrix(b, col, d)
            Q = X @ Mc
            s = b.column(si).to_numpy(zero_copy_only=False)
            if p == 2.0:
                v = np.einsum("ij,ij->i", Q, Q)
            else:
                v = np.sum(np.abs(Q) ** p, axis=1)
            if power:
                v = v * (s ** p)
            else:
                v = (v ** (1.0 / p)) * s
            cols = [b.column(i) for i in keep] + [pa.array(v, type=pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(
                [b.schema.field(i) for i in keep] + [pa.field(out, pa.float64())]))

    return src.mapInArrow(part, out_schema)


def with_bound_norm(df: DataFrame, M: np.ndarray, out: str, col: str = "x") -> DataFrame:
    """``out`` = ||x^T M||_2 with M as a broadcast one-row table, so that the generated code doesn't depend on
    its values (iterations reuse the compiled class). Large d: Arrow batch matmul."""
    d, r = M.shape
    if d > NATIVE_MAX_D or r > 32:
        return with_row_norm(df, M, out, p=2.0, power=False, col=col)
    one = df.sparkSession.createDataFrame([(0, M.T.ravel().tolist())], "_bk INT, _m ARRAY<DOUBLE>")
    total = None
    for k in range(r):
        q = None
        for j in range(d):
            t = F.col(col)[j] * F.col("_m")[k * d + j]
            q = t if q is None else q + t
        total = q * q if total is None else total + q * q
    return df.withColumn("_bk", F.lit(0)).join(F.broadcast(one), "_bk").withColumn(out, F.sqrt(total)).drop("_bk", "_m")


def dot_expr(x: Column, beta) -> Column:
    """x . beta for a literal beta vector."""
    terms = [x[j] * F.lit(float(b)) for j, b in enumerate(beta)]
    acc = terms[0]
    for t in terms[1:]:
        acc = acc + t
    return acc
