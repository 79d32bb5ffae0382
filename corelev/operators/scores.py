"""Per-row importance scores.

Every pass over the n rows is a Spark aggregate (Gram, sketch) or a projection;
the driver only factors d x d / (sketch size) x d matrices.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import random as R
from .linalg import basis_from_gram, basis_from_r, tsqr, with_bound_norm, with_row_norm
from .moments import NATIVE_MAX_D, array_width, gram
from .online import online_leverage_scores  # noqa: F401  C9-C11

JL_DIM = 20


def _n(df: DataFrame, n: int | None) -> int:
    return int(df.count()) if n is None else int(n)


# -- exact ------------------------------------------------------------------

def leverage_scores(df: DataFrame, p: float = 2.0, d: int | None = None, out: str = "score",
                    fast: bool = False, seed: int = 0, n: int | None = None,
                    jl_dim: int = JL_DIM) -> DataFrame:
    """C7 (exact) / C8 (sketched): ||Q_i||_p^p for an l2 basis Q of X.

    Exact: Q = X R^{-1} (``exact_basis``; pseudo-inverse basis when rank deficient, so
    scores sum to rank(X)). Fast: CountSketch (+ exponential
    scaling for p != 2) -> R -> JL projection (p = 2 only).
    """
    d = array_width(df) if d is None else d
    if not fast:
        return with_row_norm(df, exact_basis(df, d), out, p=p, power=True)
    M = fast_basis(df, p=p, d=d, seed=seed, n=n, jl_dim=jl_dim)
    return with_row_norm(df, M, out, p=p, power=True)


def exact_basis(df: DataFrame, d: int, well: float = 1e-3) -> np.ndarray:
    """M with X M an l2 basis of X: from the Gram's Cholesky factor while its pivots lie within a factor ``well``
    (one native aggregate), else from a QR tree over the rows, which doesn't square the condition number."""
    G = gram(df, d)
    try:
        pivots = np.diag(np.linalg.cholesky(0.5 * (G + G.T)))
        if pivots.min() > well * pivots.max():
            return basis_from_gram(G)
    except np.linalg.LinAlgError:
        pass
    return basis_from_r(tsqr(df, d))


def exact_leverage_pinv(df: DataFrame, d: int | None = None, out: str = "score") -> DataFrame:
    """x^T (X^T X)^+ x."""
    return leverage_scores(df, 2.0, d, out)


def ridge_leverage_scores(df: DataFrame, lam: float = 1e-6, d: int | None = None,
                          out: str = "score") -> DataFrame:
    """C12 (batch form): x^T (X^T X + lam I)^{-1} x."""
    d = array_width(df) if d is None else d
    G = gram(df, d) + lam * np.eye(d)
    M = basis_from_gram(G)
    return with_row_norm(df, M, out, p=2.0)


# -- sketches ----------------------------------------------------------------

def sketch_size(n: int, d: int, p: float) -> int:
    """Buckets of the sketch: d^2, or the whole part of n^(1 - 2/p) if that is more (p > 2 only)."""
    return max(d * d, int(n ** (1 - 2 / p)) if p > 2 else 0)


def _sketch_cols(df: DataFrame, s: int, p: float, seed: int, stream: str, scale: Column | None):
    b = R.bucket("id", s, seed, stream + ":f")
    sg = R.sign("id", seed, stream + ":g")
    fac = sg
    if p != 2.0:
        lam = R.exponential("id", seed, stream + ":e")
        fac = fac * F.pow(lam, F.lit(-1.0 / p))
    if scale is not None:
        fac = fac * scale
    return b, fac


def countsketch_table(df: DataFrame, s: int, d: int, p: float = 2.0, seed: int = 0,
                      stream: str = "cs", scale: Column | None = None) -> DataFrame:
    """C2/C3 as a DataFrame (bucket, j, value): a plain partial+final hash aggregate."""
    b, fac = _sketch_cols(df, s, p, seed, stream, scale)
    x = F.col("x")
    if d <= NATIVE_MAX_D * 2:
        wide = (df.select(b.alias("bucket"), fac.alias("fac"), "x")
                .groupBy("bucket").agg(*[F.sum(F.col("fac") * x[j]).alias(f"v{j}") for j in range(d)]))
        stack = ", ".join(f"{j}, v{j}" for j in range(d))
        return wide.selectExpr("bucket", f"stack({d}, {stack}) AS (j, value)")
    return (df.select(b.alias("bucket"), F.posexplode(F.transform(x, lambda v: v * fac)).alias("j", "v"))
            .groupBy("bucket", "j").agg(F.sum("v").alias("value")))


def sketch_rows(df: DataFrame, s: int, d: int, p: float = 2.0, seed: int = 0, stream: str = "cs",
                scale: Column | None = None) -> DataFrame:
    """The sketch as rows (bucket, x): at most s of them, never gathered."""
    b, fac = _sketch_cols(df, s, p, seed, stream, scale)
    if d <= NATIVE_MAX_D * 2:
        return (df.select(b.alias("bucket"), fac.alias("fac"), "x")
                .groupBy("bucket").agg(*[F.sum(F.col("fac") * F.col("x")[j]).alias(f"v{j}") for j in range(d)])
                .select("bucket", F.array(*[F.col(f"v{j}") for j in range(d)]).alias("x")))
    cells = F.array_sort(F.collect_list(F.struct("j", "value")))
    return (countsketch_table(df, s, d, p, seed, stream, scale).groupBy("bucket")
            .agg(F.transform(cells, lambda c: c["value"]).alias("x")))


def fast_basis(df: DataFrame, p: float = 2.0, d: int | None = None, seed: int = 0,
               n: int | None = None, jl_dim: int | None = JL_DIM, stream: str = "cs",
               scale: Column | None = None) -> np.ndarray:
    """R^{-1} of the CountSketch S, times a Gaussian projection of width ``jl_dim`` when p = 2.

    R is the Cholesky factor of S^T S, one more aggregate over the sketch's rows, so the driver gets d x d
    numbers for every p and d.
    """
    d = array_width(df) if d is None else d
    s = sketch_size(_n(df, n) if p > 2 else 0, d, p)
    M = basis_from_gram(gram(sketch_rows(df, s, d, p, seed, stream, scale), d))
    if p != 2.0 or not jl_dim:
        return M
    rng = np.random.default_rng([int(seed), 7919])
    return M @ rng.normal(loc=0.0, scale=jl_dim ** -0.5, size=(M.shape[1], jl_dim))


def root_leverage_scores(df: DataFrame, d: int | None = None, n: int | None = None, seed: int = 0,
                         out: str = "score", jl_dim: int = JL_DIM) -> DataFrame:
    """||Q_i||_2 + 1/n from a d^2 CountSketch and a JL projection."""
    d = array_width(df) if d is None else d
    n = _n(df, n)
    M = fast_basis(df, 2.0, d, seed, n, jl_dim)
    return with_row_norm(df, M, out, p=2.0, power=False).withColumn(out, F.col(out) + F.lit(1.0 / n))


# -- Lewis weights -----------------------------------------------------------

LEWIS_BASES = ("exact", "sketch", "gauss")


def lewis_weights(df: DataFrame, T: int = 20, fast: bool = False, d: int | None = None,
                  n: int | None = None, seed: int = 0, out: str = "score", basis: str | None = None,
                  jl_dim: int = JL_DIM) -> DataFrame:
    """l1 Lewis weights by T rounds of w <- sqrt(w * lev(W^-1/2 X)), then + 1/n.

    basis: 'exact' (pseudo-inverse of the weighted Gram; equals a full QR basis),
    'sketch' (CountSketch R only) or 'gauss' (CountSketch R and a Gaussian JL
    projection of width ``jl_dim``); ``fast=True`` is 'gauss' with k = 20.

    Since lev_i(W^-1/2 X) = x_i^T (X^T W^-1 X)^+ x_i / w_i, round t's weight is
    ||x_i^T M_t|| for a d x r matrix M_t, broadcast as one row: each round is ONE
    aggregate over the same cached (id, x) rows with the same generated code, and the
    lineage never grows. Zero rows keep weight 0 and are
    skipped in the next Gram.
    """
    basis = basis or ("gauss" if fast else "exact")
    if basis not in LEWIS_BASES:
        raise ValueError(f"basis must be one of {LEWIS_BASES}")
    d = array_width(df) if d is None else d
    n = _n(df, n)
    wcol = "__lw"
    own = not (df.storageLevel.useMemory or df.storageLevel.useDisk)
    rows = df.select("id", "x")
    rows = rows.persist() if own else rows  # read once a round
    cur = rows.withColumn(wcol, F.lit(1.0))
    for t in range(T):
        inv_w = F.when(F.col(wcol) > 0, F.lit(1.0) / F.col(wcol)).otherwise(F.lit(0.0))
        if basis == "exact":
            M = basis_from_gram(gram(cur, d, weight=inv_w), prefer="eigh")
        else:
            scale = F.when(F.col(wcol) > 0, F.lit(1.0) / F.sqrt(F.col(wcol))).otherwise(F.lit(0.0))
            M = fast_basis(cur, 2.0, d, seed, n, stream=f"lw{t}", scale=scale,
                           jl_dim=jl_dim if basis == "gauss" else None)
        cur = with_bound_norm(rows, M, wcol)
    if own:
        rows.unpersist()
    if T == 0:
        return df.withColumn(out, F.lit(1.0 + 1.0 / n))
    return with_row_norm(df, M, out, p=2.0, power=False).withColumn(out, F.col(out) + F.lit(1.0 / n))


# -- score post-processing (C13, C14, C19-C21) ------------------------------------

def augment(score: Column, n: int) -> Column:
    """Score + 1/n."""
    return score + F.lit(1.0 / n)


def round_up(score: Column) -> Column:
    """C14: round up to the next power of two; 0 stays 0 (exact at powers of two)."""
    r0 = F.pow(F.lit(2.0), F.ceil(F.log2(score)))
    r = F.when(r0 < score, r0 * 2.0).when(r0 / 2.0 >= score, r0 / 2.0).otherwise(r0)
    return F.when(score > 0, r).otherwise(score)


def check_nonnegative(df: DataFrame, col: str) -> None:
    lo = df.agg(F.min(col)).collect()[0][0]
    if lo is not None and lo < 0:
        raise ValueError(f"column {col} holds a negative value ({lo})")


def probabilities(df: DataFrame, score: str = "score", out: str = "p") -> DataFrame:
    """p_i = s_i / sum(s) with the sum as a scalar aggregate, not a global window."""
    total = df.agg(F.sum(score)).collect()[0][0]
    if not total or total <= 0:
        raise ValueError("scores must have a positive sum")
    return df.withColumn(out, F.col(score) / F.lit(float(total)))


def importance_weight(p: Column, k: int) -> Column:
    """C20: w = 1 / (p k)."""
    return F.lit(1.0) / (p * F.lit(float(k)))


def probability_from_weight(w: Column, k: int) -> Column:
    """p = 1 / (w k)."""
    return F.lit(1.0) / (w * F.lit(float(k)))
