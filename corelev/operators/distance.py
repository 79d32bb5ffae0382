"""Kernels and distances between samples.

No pairwise (cross) products over rows are ever formed:
* polynomial-kernel MMD uses the exact moment identity
  MMD^2 = 2 ||mu_x - mu_y||^2 + ||M_x - M_y||_F^2,  M = E[x x^T];
* Gaussian-kernel MMD uses random Fourier features (Rahimi & Recht 2007):
  k(a, b) ~= phi(a).phi(b), so MMD^2 ~= ||E phi(x) - E phi(y)||^2, one aggregate.
  The exact V-statistic is kept as a numpy reference (``mmd_exact_numpy``) for
  small fixtures only.
Grouped versions aggregate per group with partial (map-side) aggregation.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .moments import NATIVE_MAX_D, array_width


def gaussian_kernel(a: Column, b: Column) -> Column:
    """exp(-1/2 ||a - b||^2) for two array columns."""
    sq = F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, t: s + t)
    return F.exp(F.lit(-0.5) * sq)


def polynomial_kernel(a: Column, b: Column) -> Column:
    """(1 + a.b)^2."""
    dot = F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
    return F.pow(F.lit(1.0) + dot, F.lit(2.0))


def mmd_exact_numpy(x: np.ndarray, y: np.ndarray, kernel: str = "gaussian") -> float:
    """Biased V-statistic (reference semantics) for small in-memory samples."""
    def k(a, b):
        if kernel == "gaussian":
            d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
            return np.exp(-0.5 * np.maximum(d2, 0))
        return (1 + a @ b.T) ** 2
    v = k(x, x).mean() + k(y, y).mean() - 2 * k(x, y).mean()
    return float(np.sqrt(max(v, 0.0)))


# -- moments per group -------------------------------------------------------------

def grouped_moments(df: DataFrame, group_cols, d: int, col: str = "x") -> DataFrame:
    """Per group: cnt, s1 ARRAY (sum x), s2 ARRAY (sum x x^T, row-major d*d)."""
    g = list(group_cols)
    x = F.col(col)
    if d <= NATIVE_MAX_D:
        aggs = [F.count(F.lit(1)).alias("cnt")]
        aggs += [F.sum(x[i]).alias(f"a{i}") for i in range(d)]
        aggs += [F.sum(x[i] * x[j]).alias(f"b{i}_{j}") for i in range(d) for j in range(i, d)]
        t = df.groupBy(*g).agg(*aggs)
        s2 = [F.col(f"b{min(i, j)}_{max(i, j)}") for i in range(d) for j in range(d)]
        return t.select(*g, "cnt", F.array(*[F.col(f"a{i}") for i in range(d)]).alias("s1"),
                        F.array(*s2).alias("s2"))
    # large d: each Arrow batch gives X^T X per group with numpy, at most 32 MB of sums at a time; partials are
    # summed by (group, position) on the executors and packed back per group
    key_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    width = 1 + d + d * d
    most = max(1, 4_000_000 // width)  # groups whose sums are held at once

    def part(it):
        for pdf in it:
            if pdf.empty:
                continue
            X = np.stack(pdf[col].to_numpy()).astype(float).reshape(-1, d)
            code = pdf.groupby(g, dropna=False, sort=False).ngroup().to_numpy() if g else np.zeros(len(pdf), int)
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
            ends = np.r_[first[1:], len(order)]
            for a in range(0, len(first), most):
                sums = []
                for s, e in zip(first[a:a + most], ends[a:a + most]):
                    Xg = X[order[s:e]]
                    sums.append(np.concatenate([[float(e - s)], Xg.sum(0), (Xg.T @ Xg).ravel()]))
                keys = pdf[g].iloc[np.repeat(order[first[a:a + most]], width)].reset_index(drop=True)
                yield keys.assign(k=np.tile(np.arange(width, dtype=np.int32), len(sums)), v=np.concatenate(sums))

    schema = ", ".join([f"{c} {key_types[c]}" for c in g] + ["k INT", "v DOUBLE"])
    long = df.select(*g, col).mapInPandas(part, schema).groupBy(*g, "k").agg(F.sum("v").alias("v"))
    packed = long.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("kv"))
    vals = F.transform("kv", lambda s: s["v"])
    return packed.select(*g, vals[0].cast("long").alias("cnt"), F.slice(vals, 2, d).alias("s1"),
                         F.slice(vals, d + 2, d * d).alias("s2"))


def _moment_stats(m: DataFrame) -> DataFrame:
    """mu = s1 / n, M = s2 / n."""
    n = F.col("cnt").cast("double")
    return m.withColumn("mu", F.transform("s1", lambda v: v / n)).withColumn(
        "M", F.transform("s2", lambda v: v / n))


def _sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, t: s + t)


def _two_rows(stats: DataFrame, cols) -> DataFrame:
    """Collapse the tag-0 / tag-1 rows of a 2-row stats table into one row."""
    out = []
    for c in cols:
        out += [F.min_by(c, "_tag").alias(f"{c}_x"), F.max_by(c, "_tag").alias(f"{c}_y")]
    return stats.agg(*out)


def mmd_polynomial(x: DataFrame, y: DataFrame, col: str = "x") -> DataFrame:
    """F6 (polynomial kernel), exact, from first and second moments. One row: mmd."""
    d = array_width(x, col)
    tagged = x.select(F.col(col).alias("v"), F.lit(0).alias("_tag")).unionByName(
        y.select(F.col(col).alias("v"), F.lit(1).alias("_tag")))
    st = _two_rows(_moment_stats(grouped_moments(tagged, ["_tag"], d, "v")), ["mu", "M"])
    v = F.lit(2.0) * _sq_dist(F.col("mu_x"), F.col("mu_y")) + _sq_dist(F.col("M_x"), F.col("M_y"))
    return st.select(F.sqrt(F.greatest(v, F.lit(0.0))).alias("mmd"))


def mmd_polynomial_grouped(samples: DataFrame, reference: DataFrame, group_cols, col: str = "x") -> DataFrame:
    """polynomial MMD of each group of ``samples`` against ``reference``."""
    d = array_width(reference, col)
    ref = _moment_stats(grouped_moments(reference.withColumn("_k", F.lit(0)), ["_k"], d, col)) \
        .select("_k", F.col("mu").alias("mur"), F.col("M").alias("Mr"))
    gm = _moment_stats(grouped_moments(samples, group_cols, d, col)).withColumn("_k", F.lit(0))
    j = gm.join(F.broadcast(ref), "_k")
    v = F.lit(2.0) * _sq_dist(F.col("mu"), F.col("mur")) + _sq_dist(F.col("M"), F.col("Mr"))
    return j.select(*group_cols, F.sqrt(F.greatest(v, F.lit(0.0))).alias("mmd"))


def rff_params(d: int, features: int = 512, seed: int = 0, bandwidth: float = 1.0):
    """Random Fourier frequencies for exp(-||a-b||^2 / (2 h^2)), drawn on the driver."""
    rng = np.random.default_rng([int(seed), 15485863])
    W = rng.normal(0.0, 1.0 / bandwidth, size=(features, d))
    b = rng.uniform(0.0, 2 * math.pi, size=features)
    return W, b


def rff_columns(x: Column, W: np.ndarray, b: np.ndarray) -> list:
    """phi_k(x) = sqrt(2/D) cos(w_k . x + b_k) as native expressions."""
    D, d = W.shape
    c = math.sqrt(2.0 / D)
    out = []
    for k in range(D):
        acc = F.lit(float(b[k]))
        for j in range(d):
            acc = acc + x[j] * F.lit(float(W[k, j]))
        out.append(F.lit(c) * F.cos(acc))
    return out


def mmd_gaussian_rff(x: DataFrame, y: DataFrame, features: int = 256, seed: int = 0,
                     col: str = "x", bandwidth: float = 1.0) -> DataFrame:
    """F6 (Gaussian kernel) by random Fourier features: ||mean phi(x) - mean phi(y)||.

    Each Arrow batch maps its rows to the D features with one numpy matmul and
    emits per-partition feature sums per sample; the sums are combined with a
    small (sample, feature) aggregate. Work is linear in the rows.
    """
    import pyarrow as pa

    from .moments import _batch_matrix

    d = array_width(x, col)
    W, b = rff_params(d, features, seed, bandwidth)
    c = math.sqrt(2.0 / features)
    tagged = x.select(F.col(col).alias("v"), F.lit(0).alias("_tag")).unionByName(
        y.select(F.col(col).alias("v"), F.lit(1).alias("_tag")))

    def part(batches):
        acc = {0: np.zeros(features), 1: np.zeros(features)}
        cnt = {0: 0, 1: 0}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            V = _batch_matrix(batch, "v", d)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            phi = c * np.cos(V @ W.T + b)
            for t in (0, 1):
                m = tags == t
                if m.any():
                    acc[t] += phi[m].sum(0)
                    cnt[t] += int(m.sum())
        tags_out, pos, vals = [], [], []
        for t in (0, 1):
            if cnt[t]:
                tags_out += [t] * (features + 1)
                pos += list(range(features + 1))
                vals += acc[t].tolist() + [float(cnt[t])]
        yield pa.RecordBatch.from_arrays([pa.array(tags_out, pa.int32()), pa.array(pos, pa.int32()),
                                          pa.array(vals, pa.float64())], names=["_tag", "pos", "val"])

    sums = tagged.mapInArrow(part, "_tag INT, pos INT, val DOUBLE").groupBy("_tag", "pos").agg(
        F.sum("val").alias("val"))
    cnts = sums.filter(F.col("pos") == features).select("_tag", F.col("val").alias("cnt"))
    means = sums.filter(F.col("pos") < features).join(F.broadcast(cnts), "_tag") \
        .withColumn("m", F.col("val") / F.col("cnt"))
    diff = means.groupBy("pos").agg((F.sum(F.when(F.col("_tag") == 0, F.col("m")).otherwise(0.0))
                                     - F.sum(F.when(F.col("_tag") == 1, F.col("m")).otherwise(0.0))).alias("dm"))
    return diff.agg(F.sqrt(F.greatest(F.sum(F.col("dm") * F.col("dm")), F.lit(0.0))).alias("mmd"))


def mmd_feature_map(x: DataFrame, y: DataFrame, phi, col: str = "x") -> DataFrame:
    """F6 with a user kernel k(a, b) = phi(a) . phi(b) given as a feature map
    ``phi: Column(array) -> Column(array)`` (G12 hook): MMD = ||E phi(x) - E phi(y)||,
    one aggregate per sample, no pairs."""
    tagged = x.select(phi(F.col(col)).alias("f"), F.lit(0).alias("_tag")).unionByName(
        y.select(phi(F.col(col)).alias("f"), F.lit(1).alias("_tag")))
    means = tagged.select("_tag", F.posexplode("f").alias("pos", "v")).groupBy("_tag", "pos") \
        .agg(F.avg("v").alias("m"))
    diff = means.groupBy("pos").agg((F.sum(F.when(F.col("_tag") == 0, F.col("m")).otherwise(0.0))
                                     - F.sum(F.when(F.col("_tag") == 1, F.col("m")).otherwise(0.0))).alias("dm"))
    return diff.agg(F.sqrt(F.greatest(F.sum(F.col("dm") * F.col("dm")), F.lit(0.0))).alias("mmd"))


def polynomial_features(a: Column, d: int) -> Column:
    """Explicit features of (1 + a.b)^2: [1, sqrt2 a_i, a_i a_j] with k(a, b) = phi(a).phi(b)."""
    r2 = math.sqrt(2.0)
    feats = [F.lit(1.0)] + [a[i] * F.lit(r2) for i in range(d)]
    feats += [a[i] * a[j] for i in range(d) for j in range(d)]
    return F.array(*feats)


def mean_distance_grouped(samples: DataFrame, reference: DataFrame, group_cols, col: str = "beta") -> DataFrame:
    """||mean(group) - mean(reference)||_2 per group."""
    d = array_width(reference, col)
    ref = reference.agg(*[F.avg(F.col(col)[j]).alias(f"r{j}") for j in range(d)]).withColumn("_k", F.lit(0))
    gm = samples.groupBy(*group_cols).agg(*[F.avg(F.col(col)[j]).alias(f"m{j}") for j in range(d)])
    j = gm.withColumn("_k", F.lit(0)).join(F.broadcast(ref), "_k")
    ss = None
    for k in range(d):
        t = (F.col(f"m{k}") - F.col(f"r{k}")) * (F.col(f"m{k}") - F.col(f"r{k}"))
        ss = t if ss is None else ss + t
    return j.select(*group_cols, F.sqrt(ss).alias("norm"))


def covariance_spectral_grouped(samples: DataFrame, reference: DataFrame, group_cols,
                                col: str = "beta") -> DataFrame:
    """F8: spectral norm of cov(group) - cov(reference) (sample covariances, ddof = 1).

    Moments are aggregated in Spark; only the per-group d x d difference reaches a
    pandas kernel for the eigenvalues.
    """
    import pandas as pd

    d = array_width(reference, col)
    g = list(group_cols)
    rm = grouped_moments(reference.withColumn("_g", F.lit(0)), ["_g"], d, col).collect()[0]
    n = rm["cnt"]
    mu = np.array(rm["s1"]) / n
    cov_ref = (np.array(rm["s2"]).reshape(d, d) - n * np.outer(mu, mu)) / (n - 1)
    gm = grouped_moments(samples, g, d, col)

    def kernel(pdf: "pd.DataFrame") -> "pd.DataFrame":
        res = []
        for _, r in pdf.iterrows():
            m = r["cnt"]
            mv = np.asarray(r["s1"], dtype=float) / m
            cov = (np.asarray(r["s2"], dtype=float).reshape(d, d) - m * np.outer(mv, mv)) / (m - 1)
            ev = np.linalg.eigvalsh(0.5 * ((cov - cov_ref) + (cov - cov_ref).T))
            res.append({**{c: r[c] for c in g}, "matrix_norm": float(np.max(np.abs(ev)))})
        return pd.DataFrame(res, columns=g + ["matrix_norm"])

    types = {f.name: f.dataType.simpleString() for f in gm.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in g) + ", matrix_norm DOUBLE"
    return gm.groupBy(*g).applyInPandas(kernel, schema)


def coefficient_stats(draws: DataFrame, group_cols, col: str = "beta", j: int = 0) -> DataFrame:
    """mean and population variance (np.var) of coefficient j per group, long form."""
    t = draws.groupBy(*group_cols).agg(F.avg(F.col(col)[j]).alias("mean"),
                                       F.var_pop(F.col(col)[j]).alias("variance"))
    return t.unpivot(list(group_cols), ["mean", "variance"], "statistic", "value")
