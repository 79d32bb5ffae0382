"""Row-level helpers on designs and result tables.

All are plain projections, filters or a single unpivot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linalg import dot_expr


def margins(df: DataFrame, beta, out: str = "margin") -> DataFrame:
    """X.beta per row."""
    return df.withColumn(out, dot_expr(F.col("x"), beta))


def misclassified(df: DataFrame, beta) -> DataFrame:
    """Rows with y * x.beta < 0."""
    return margins(df, beta).filter(F.col("margin") * F.col("y") < 0)


def normalised_residual(df: DataFrame, beta, out: str = "residual") -> DataFrame:
    """X.beta / ||beta|| of misclassified rows."""
    nb = float(np.linalg.norm(beta))
    return misclassified(df, beta).withColumn(out, F.col("margin") / F.lit(nb))


def boundary_lines(betas: DataFrame, x_min: float, x_max: float, steps: int = 100,
                   key_cols=("method",)) -> DataFrame:
    """Points of the 2-D decision boundary y = -b0/b1 x - b2/b1 on a grid per beta row."""
    step = (x_max - x_min) / max(steps - 1, 1)
    xs = F.sequence(F.lit(0), F.lit(steps - 1))
    t = betas.select(*key_cols, "beta", F.explode(xs).alias("_i"))
    xv = F.lit(x_min) + F.col("_i") * F.lit(step)
    b = F.col("beta")
    return t.select(*key_cols, xv.alias("x"), (-b[0] / b[1] * xv - b[2] / b[1]).alias("y"))


def filter_values(df: DataFrame, col: str, values) -> DataFrame:
    """Rows whose ``col`` is one of ``values``."""
    return df.filter(F.col(col).isin(list(values)))


def melt(df: DataFrame, id_cols, value_cols=None, variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide -> long (pandas ``melt``)."""
    ids = list(id_cols)
    vals = list(value_cols) if value_cols is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(ids, vals, variable, value)


def coefficient_index(name: Column) -> Column:
    """B16: 'beta_7' -> 7."""
    return F.split(name, "_").getItem(1).cast("int")


def tag(df: DataFrame, **cols) -> DataFrame:
    """Constant columns (e.g. method name)."""
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v))
    return df


def principal_axes(df: DataFrame, d: int, k: int = 2):
    """D9 helper: top-k eigenvectors of the centred covariance (from one moments pass), each with its largest entry positive."""
    from .moments import gram

    G, s = gram(df, d, vector=F.lit(1.0))
    n = df.count()
    mu = s / n
    cov = G / n - np.outer(mu, mu)
    lam, V = np.linalg.eigh(0.5 * (cov + cov.T))
    V = V[:, np.argsort(lam)[::-1][:k]]
    return mu, V * np.sign(V[np.argmax(np.abs(V), axis=0), np.arange(V.shape[1])])


def project_2d(df: DataFrame, mu, V, label: str) -> DataFrame:
    """Rows projected on two principal components, tagged with ``label``."""
    cols = []
    for c in range(V.shape[1]):
        e = None
        for j in range(V.shape[0]):
            t = (F.col("x")[j] - F.lit(float(mu[j]))) * F.lit(float(V[j, c]))
            e = t if e is None else e + t
        cols.append(e.alias(f"pc{c + 1}"))
    return df.select("id", *cols, F.lit(label).alias("sample"))
