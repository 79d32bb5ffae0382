"""p-generalised probit: loss, gradient, fits, evaluation.

A full-data evaluation is ONE Spark aggregate returning (sum w g, sum w g' (-y x),
sum w g'' x x^T); the d-vector optimisation runs on the driver. We use a damped
Newton method (the loss is convex), so a fit takes ~10 passes over the data
instead of the 30-100 function/gradient calls of BFGS. Coresets (bounded k) are
fitted inside one task each with the same Newton method in numpy.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pnormal as PN
from .linalg import dot_expr
from .moments import NATIVE_MAX_D, _batch_matrix, array_width


def _triu(d):
    return [(i, j) for i in range(d) for j in range(i, d)]


def loss_columns(df: DataFrame, beta, p: float, tail: str = "exact", margin: Column | None = None,
                 with_hess: bool = True) -> DataFrame:
    """Append z = -y x.beta, g(z), g'(z) (and g''(z)) as native columns."""
    p = float(p)
    z = margin if margin is not None else -F.col("y").cast("double") * dot_expr(F.col("x"), beta)
    out = df.withColumn("_z", z)
    out = out.withColumn("_s", F.expr(PN.sql_s("_z", p)))
    out = out.withColumn("_lc", F.expr(PN.sql_ln_cdf_neg("_z", "_s", p)))
    g, gp = PN.sql_from_lcdf("_z", "_s", "_lc", p, tail=tail)
    out = out.withColumn("_g", F.expr(g)).withColumn("_gp", F.expr(gp))
    if with_hess:
        out = out.withColumn("_h", F.expr(PN.sql_hess("_z", "_gp", p)))
    return out


def _native_eval(df, beta, p, d, tail, want_hess=True):
    # beta travels as a broadcast one-row table joined on a constant key, not as
    # literals: the generated code is then identical for every Newton step and
    # whole-stage codegen reuses the compiled class.
    spark = df.sparkSession
    bdf = spark.createDataFrame([(0, [float(b) for b in beta])], "_bk INT, _beta ARRAY<DOUBLE>")
    j = df.withColumn("_bk", F.lit(0)).join(F.broadcast(bdf), "_bk")
    z = None
    for k in range(d):
        t = F.col("x")[k] * F.col("_beta")[k]
        z = t if z is None else z + t
    t = loss_columns(j, None, p, tail, margin=-F.col("y").cast("double") * z, with_hess=want_hess)
    x, w, y = F.col("x"), F.col("w"), F.col("y").cast("double")
    aggs = [F.sum(w * F.col("_g")).alias("f"), F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(-w * F.col("_gp") * y * x[j]).alias(f"g{j}") for j in range(d)]
    if want_hess:
        aggs += [F.sum(w * F.col("_h") * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in _triu(d)]
    r = t.agg(*aggs).collect()[0]
    f = float(r["f"] or 0.0)
    g = np.array([r[f"g{j}"] or 0.0 for j in range(d)])
    H = None
    if want_hess:
        H = np.zeros((d, d))
        for i, j in _triu(d):
            H[i, j] = H[j, i] = r[f"h{i}_{j}"] or 0.0
    return f, g, H, int(r["n"] or 0)


def _arrow_eval(df, beta, p, d, tail, want_hess=True):
    b = np.asarray(beta, dtype=float)
    flat = d <= NATIVE_MAX_D  # few entries travel as columns of their own
    x = [F.col("x")[k].cast("double").alias(f"x{k}") for k in range(d)] if flat else [F.col("x")]
    sel = df.select(F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"), *x)

    def part(batches):
        f, n = 0.0, 0
        g = np.zeros(d)
        H = np.zeros((d, d))
        for batch in batches:
            n += batch.num_rows
            if flat and any(c.null_count for c in batch.columns):
                batch = batch.drop_null()  # a sum skips rows with a null, the count doesn't
            if batch.num_rows == 0:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in (batch.columns if flat else batch.columns[:2])]
            y, w = cols[:2]
            X = np.stack(cols[2:], axis=1) if flat else _batch_matrix(batch, "x", d)
            z = -y * (X @ b)
            gv, gpv, hv = PN.np_loss_grad_hess(z, p, tail, want_hess)
            f += float(np.sum(w * gv))
            g += X.T @ (-w * gpv * y)
            if want_hess:
                H += X.T @ (X * (w * hv)[:, None])
        vals = [f, float(n)] + g.tolist() + H[np.triu_indices(d)].tolist()
        yield pa.RecordBatch.from_arrays([pa.array([vals], type=pa.list_(pa.float64()))], names=["v"])

    rows = (sel.mapInArrow(part, "v ARRAY<DOUBLE>").select(F.posexplode("v").alias("pos", "val"))
            .groupBy("pos").agg(F.sum("val").alias("val")).collect())
    vals = np.zeros(2 + d + d * (d + 1) // 2)
    for r in rows:
        vals[r["pos"]] = r["val"]
    H = np.zeros((d, d))
    H[np.triu_indices(d)] = vals[2 + d:]
    H = H + np.triu(H, 1).T
    return vals[0], vals[2:2 + d], (H if want_hess else None), int(vals[1])


def evaluate(df: DataFrame, beta, p: float, d: int | None = None, tail: str = "exact",
             want_hess: bool = True):
    """(f, grad, Hessian, n) of sum w g(-y x.beta) in one pass."""
    d = len(beta) if d is None else d
    if len(beta) != d:
        raise ValueError(f"beta has {len(beta)} entries, the design has {d} columns")
    # p = 1 has a short closed form; the series and the continued fraction of other p make generated
    # methods too long for the JVM's compiler, so numpy takes them, each row its own branch
    if p == 1 and d <= NATIVE_MAX_D:
        return _native_eval(df, beta, p, d, tail, want_hess)
    return _arrow_eval(df, beta, p, d, tail, want_hess)


def negative_log_likelihood(df: DataFrame, beta, p: float, tail: str = "exact") -> float:
    """E6."""
    return evaluate(df, beta, p, len(beta), tail, want_hess=False)[0]


def gradient(df: DataFrame, beta, p: float, tail: str = "exact") -> np.ndarray:
    """E7."""
    return evaluate(df, beta, p, len(beta), tail, want_hess=False)[1]


class FitResult:
    def __init__(self, beta, f, grad, iterations, converged, n):
        self.beta, self.f, self.grad = beta, f, grad
        self.iterations, self.converged, self.n = iterations, converged, n

    def __repr__(self):
        return f"FitResult(beta={self.beta}, f={self.f}, iters={self.iterations}, converged={self.converged})"


def _backtrack(alpha, f0, f1, slope):
    """Safeguarded quadratic-interpolation backtracking step in [0.1, 0.5] * alpha."""
    if not np.isfinite(f1):
        return 0.1 * alpha
    denom = 2.0 * (f1 - f0 - slope * alpha)
    a = -slope * alpha * alpha / denom if denom > 0 else 0.5 * alpha
    return float(min(0.5 * alpha, max(0.1 * alpha, a)))


def newton(evalf, d, max_iter=100, gtol=1e-9, warn=True):
    """Damped Newton with Armijo backtracking; ``evalf(beta) -> (f, g, H, n)``."""
    beta = np.zeros(d)
    f, g, H, n = evalf(beta)
    n = max(n, 1)
    it, converged = 0, False
    for it in range(1, max_iter + 1):
        if np.max(np.abs(g)) / n < gtol:
            converged = True
            break
        Hs = 0.5 * (H + H.T)
        mu = 1e-10 * max(np.trace(Hs) / d, 1e-300)
        try:
            step = -np.linalg.solve(Hs + mu * np.eye(d), g)
        except np.linalg.LinAlgError:
            step = -g
        slope = float(g @ step)
        if slope >= 0:
            step, slope = -g, -float(g @ g)
        alpha, accepted = 1.0, False
        for _ in range(60):
            nb = beta + alpha * step
            f2, g2, H2, _ = evalf(nb)
            if np.isfinite(f2) and f2 <= f + 1e-4 * alpha * slope:
                accepted = True
                break
            alpha = _backtrack(alpha, f, f2, slope)
        if not accepted:
            break
        rel = abs(f - f2) / max(1.0, abs(f))
        beta, f, g, H = nb, f2, g2, H2
        if rel < 1e-15 and np.max(np.abs(g)) / n < 1e-5:
            converged = True
            break
    else:
        converged = np.max(np.abs(g)) / n < 1e-5
    if not converged and np.max(np.abs(g)) / n < 1e-5:
        converged = True
    if warn and not converged:
        warnings.warn("Newton stopped before the gradient was small")
    return FitResult(beta, f, g, it, converged, n)


def fit(df: DataFrame, p: float = 2.0, d: int | None = None, tail: str = "exact",
        max_iter: int = 100, check: bool = True) -> FitResult:
    """Maximum-likelihood beta of the weighted p-probit model on a design table.

    The design should be persisted by the caller: every Newton step is a pass.
    """
    from ..sources.design import validate_design

    d = array_width(df) if d is None else d
    if check:
        validate_design(df, require_both=True)
    return newton(lambda b: evaluate(df, b, p, d, tail), d, max_iter)


# -- numpy (inside one task, for bounded coresets) ------------------------------

def np_evaluate(X, y, w, beta, p, tail="exact"):
    z = -y * (X @ beta)
    gv, gpv, hv = PN.np_loss_grad_hess(z, p, tail)
    return float(np.sum(w * gv)), X.T @ (-w * gpv * y), X.T @ (X * (w * hv)[:, None]), len(y)


def np_fit(X, y, w, p, tail="exact", max_iter=100, warn=False):
    X = np.asarray(X, dtype=float)
    y = np.asarray(y, dtype=float)
    w = np.ones(len(y)) if w is None else np.asarray(w, dtype=float)
    if not set(np.unique(y.astype(int))) == {-1, 1}:
        raise ValueError("labels must be -1 and 1, and both must occur")
    return newton(lambda b: np_evaluate(X, y, w, b, p, tail), X.shape[1], max_iter, warn=warn)


def fit_groups(df: DataFrame, group_cols, p: float, d: int, tail: str = "exact",
               max_group_rows: int = 2_000_000, size_col: str | None = None, sizes=None,
               known_max_rows: int | None = None) -> DataFrame:
    """Fit one model per group (coreset) inside one task each.

    Output: group cols (+ size), beta ARRAY<DOUBLE> (null if the group has one class),
    converged, iterations. With ``sizes``, each group holds ranked rows (``rank``)
    and one fit is made per size on ``rank <= size`` with the weights
    computed as 1/(p size) from column ``p`` (or 1 when ``p`` is absent).
    A size above a group's rows gives a row with a null beta. When a group is above
    ``max_group_rows`` (what one task should hold) all are fitted by ``fit_lockstep``
    instead, to the same optimum; callers that know the largest group (a coreset of
    size k) pass ``known_max_rows`` to skip the count.
    """
    import pandas as pd

    gcols = list(group_cols)
    mx = known_max_rows
    if mx is None and sizes is not None:
        mx = max(int(v) for v in sizes)
    if mx is None:
        mx = df.groupBy(*gcols).count().agg(F.max("count")).collect()[0][0]
    has_p = "p" in df.columns
    size_list = sorted(int(s) for s in sizes) if sizes is not None else None
    if mx is not None and mx > max_group_rows:
        if size_list is None:
            return fit_lockstep(df, gcols, p, d, tail)
        every = df.withColumn("size", F.explode(F.array(*[F.lit(s) for s in size_list])))
        full = every.groupBy(*gcols, "size").agg((F.count(F.lit(1)) >= F.col("size")).alias("_full"))
        rows = every.filter(F.col("rank") <= F.col("size"))
        rows = rows.withColumn("w", F.lit(1.0) / (F.col("p") * F.col("size")) if has_p else F.col("w"))
        fits = fit_lockstep(rows, [*gcols, "size"], p, d, tail)
        return (full.join(fits, [*gcols, "size"], "left")
                .select(*gcols, "size", F.when(F.col("_full"), F.col("beta")).alias("beta"),
                        F.coalesce(F.col("_full") & F.col("converged"), F.lit(False)).alias("converged"),
                        F.when(F.col("_full"), F.col("iterations")).otherwise(0).alias("iterations")))
    sel = gcols + ["x", "y", "w"] + (["p"] if has_p else []) + (["rank"] if size_list else [])

    def one(X, y, w):
        try:
            r = np_fit(X, y, w, p, tail)
            return list(map(float, r.beta)), bool(r.converged), int(r.iterations)
        except ValueError:
            return None, False, 0

    def kernel(pdf: "pd.DataFrame") -> "pd.DataFrame":
        X = np.stack(pdf["x"].to_numpy()).astype(float).reshape(-1, d)
        y = pdf["y"].to_numpy().astype(float)
        rows = []
        key = {c: pdf[c].iloc[0] for c in gcols}
        if size_list is None:
            b, c, it = one(X, y, pdf["w"].to_numpy().astype(float))
            rows.append({**key, "beta": b, "converged": c, "iterations": it})
        else:
            order = np.argsort(pdf["rank"].to_numpy(), kind="mergesort")
            X, y = X[order], y[order]
            pr = pdf["p"].to_numpy()[order] if has_p else None
            wfix = pdf["w"].to_numpy()[order].astype(float)
            for s in size_list:
                if s > len(y):
                    rows.append({**key, "size": s, "beta": None, "converged": False, "iterations": 0})
                    continue
                w = 1.0 / (pr[:s] * s) if has_p else wfix[:s]
                b, c, it = one(X[:s], y[:s], w)
                rows.append({**key, "size": s, "beta": b, "converged": c, "iterations": it})
        return pd.DataFrame(rows)

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in gcols)
    if size_list is not None:
        schema += ", size INT"
    schema += ", beta ARRAY<DOUBLE>, converged BOOLEAN, iterations INT"
    return df.select(*sel).groupBy(*gcols).applyInPandas(kernel, schema)


# -- evaluation of many betas on the full data (E13, E14) ---------------------

def losses_for_betas(df: DataFrame, betas: DataFrame, key_cols, p: float, d: int,
                     tail: str = "exact", block_configs: int = 20_000) -> DataFrame:
    """sum w g(-y x.beta) on the FULL data for every row of ``betas`` (key cols, beta).

    The betas are broadcast in blocks of ``block_configs`` (blocks x d doubles, one pass
    over the data each); every Arrow batch computes Z = X B^T for the block's configs in
    numpy and emits one partial loss per config, so no (row, config) pairs are
    materialised and the data side is never shuffled.
    """
    keys = list(key_cols)
    schema = betas.select(*keys).schema
    out, block = None, []

    def flush(rows, out):
        one = _block_losses(df, rows, keys, schema, p, d, tail)
        return one if out is None else out.unionByName(one)

    for r in betas.filter(F.col("beta").isNotNull()).select(*keys, "beta").toLocalIterator():
        block.append(r)
        if len(block) == block_configs:
            out, block = flush(block, out), []
    if block:
        out = flush(block, out)
    return df.sparkSession.createDataFrame([], schema.add("loss", "double")) if out is None else out


def _block_losses(df, brows, keys, schema, p, d, tail):
    B = np.array([list(r["beta"]) for r in brows], dtype=float)
    if B.shape[1] != d:
        raise ValueError(f"beta has {B.shape[1]} entries, the design has {d} columns")
    C = len(brows)
    sent = df.sparkSession.sparkContext.broadcast(B)
    sel = df.select("x", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"))

    def part(batches):
        B = sent.value
        acc = np.zeros(C)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            X = _batch_matrix(batch, "x", d)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            w = batch.column(2).to_numpy(zero_copy_only=False)
            step = max(1, 4_000_000 // max(C, 1))
            for s0 in range(0, len(y), step):
                Z = -(y[s0:s0 + step, None]) * (X[s0:s0 + step] @ B.T)
                acc += w[s0:s0 + step] @ PN.np_loss(Z.ravel(), p, tail).reshape(Z.shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(C, dtype=np.int64)), pa.array(acc)],
                                         names=["_cix", "loss"])

    part_losses = sel.mapInArrow(part, "_cix BIGINT, loss DOUBLE").groupBy("_cix").agg(F.sum("loss").alias("loss"))
    keyrows = [tuple([i] + [r[k] for k in keys]) for i, r in enumerate(brows)]
    keydf = df.sparkSession.createDataFrame(keyrows, _prepend_cfg(schema))
    return keydf.join(part_losses, "_cix").drop("_cix")


def _prepend_cfg(schema):
    from pyspark.sql.types import LongType, StructField, StructType

    return StructType([StructField("_cix", LongType())] + list(schema.fields))


def approximation_ratio(df: DataFrame, betas: DataFrame, key_cols, beta_opt, p: float, d: int,
                        tail: str = "exact", f_opt: float | None = None) -> DataFrame:
    """f(beta_r) / f(beta_opt) for every config; null when the coreset had one class."""
    if f_opt is None:
        f_opt = negative_log_likelihood(df, beta_opt, p, tail)
    keys = list(key_cols)
    losses = losses_for_betas(df, betas, keys, p, d, tail)
    return (betas.select(*keys).join(losses, keys, "left")
            .withColumn("ratio", F.col("loss") / F.lit(float(f_opt))).drop("loss"))


def beta_distances(betas: DataFrame, beta_opt, key_cols) -> DataFrame:
    """||beta - beta_opt||_2 and ||.||_inf per config."""
    bo = F.array(*[F.lit(float(v)) for v in beta_opt])
    diff = F.zip_with("beta", bo, lambda a, b: a - b)
    return betas.select(*key_cols,
                        F.sqrt(F.aggregate(diff, F.lit(0.0), lambda acc, v: acc + v * v)).alias("beta_l2"),
                        F.array_max(F.transform(diff, lambda v: F.abs(v))).alias("beta_inf"))


# -- SGD (E10-E12) ----------------------------------------------------------------

def sgd_partition_kernel(p: float, d: int, eta0: float = 0.1, power_t: float = 0.5, tail: str = "exact"):
    """Sequential SGD over each shard of a partition's rows (x, y, shard), in their order; yields (beta, count) per shard."""

    def part(batches):
        gfun = PN.scalar_grad(p)
        beta, t, shard = [0.0] * d, 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            X = _batch_matrix(batch, "x", d).tolist()
            y = batch.column(1).to_numpy(zero_copy_only=False).tolist()
            for xi, yi, si in zip(X, y, batch.column(2).to_pylist()):
                if si != shard:
                    if t:
                        yield done(beta, t)
                    shard, beta, t = si, [0.0] * d, 0
                t += 1
                m = -yi * sum(b * v for b, v in zip(beta, xi))
                step = (eta0 / t ** power_t) * gfun(m) * (-yi)
                beta = [b - step * v for b, v in zip(beta, xi)]
        if t:
            yield done(beta, t)

    def done(beta, t):
        return pa.RecordBatch.from_arrays([pa.array([beta], type=pa.list_(pa.float64())),
                                           pa.array([t], type=pa.int64())], names=["beta", "cnt"])

    return part


def sgd_shards(rows: int, rows_a_shard: int = 1_000_000) -> int:
    return max(8, -(-rows // rows_a_shard))


def sgd_epoch(df: DataFrame, p: float = 2.0, d: int | None = None, seed: int = 0, eta0: float = 0.1,
              power_t: float = 0.5, shards: int | None = None) -> np.ndarray:
    """One random-order epoch over ``shards`` shards; their parameters averaged by row count.

    Random order = hash of (id, seed); a row's shard is its hash times ``shards``, and each
    shard is read in hash order by one task. The result depends on ``shards``, not on cores
    or partitions: more shards are more parallel and average shorter runs. By default there is
    one a million rows, at least 8 (``sgd_shards``).
    """
    from ..functions import random as R

    shards = sgd_shards(df.count()) if shards is None else shards
    d = array_width(df) if d is None else d
    keyed = df.select("x", F.col("y").cast("double").alias("y"), R.uniform("id", seed, "sgd").alias("_o"))
    keyed = keyed.withColumn("_s", F.floor(F.col("_o") * shards))
    shuffled = keyed.repartitionByRange(shards, "_s").sortWithinPartitions("_s", "_o")
    parts = shuffled.select("x", "y", "_s").mapInArrow(sgd_partition_kernel(p, d, eta0, power_t),
                                                       "beta ARRAY<DOUBLE>, cnt BIGINT")
    agg = parts.select(F.posexplode("beta").alias("j", "b"), "cnt") \
        .groupBy("j").agg((F.sum(F.col("b") * F.col("cnt")) / F.sum("cnt")).alias("b")).collect()
    beta = np.zeros(d)
    for r in agg:
        beta[r["j"]] = r["b"]
    return beta


# -- many large coresets at once (lockstep Newton) ---------------------------------

def fit_lockstep(stacked: DataFrame, key_cols, p: float, d: int, tail: str = "exact",
                 max_iter: int = 100, gtol: float = 1e-9, block_configs: int = 20_000) -> DataFrame:
    """Fit one model per config on stacked coresets of any size.

    Every Newton round is ONE grouped aggregate (f, gradient, Hessian per config)
    over the stacked rows joined to a small per-config beta table on the config
    key; converged configs leave the active set. Used when a coreset is too large
    for ``fit_groups``' in-task fit. Returns key cols, beta, converged, iterations.
    """
    keys = list(key_cols)
    spark = stacked.sparkSession
    data = stacked.select(*keys, "x", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"))
    labels = data.groupBy(*keys).agg(F.countDistinct("y").alias("_k"))
    blocks = -(-labels.count() // block_configs)
    if blocks > 1:
        own = F.pmod(F.xxhash64(*keys), F.lit(2 * blocks))
        out = None
        for b in range(2 * blocks):
            one = fit_lockstep(stacked.where(own == b), keys, p, d, tail, max_iter, gtol, 1 << 62)
            out = one if out is None else out.unionByName(one)
        return out
    labels = labels.collect()
    state = {}
    for r in labels:
        k = tuple(r[c] for c in keys)
        state[k] = {"beta": np.zeros(d), "alpha": 1.0, "f": None, "g": None, "H": None, "n": 0,
                    "cand": np.zeros(d), "done": r["_k"] < 2, "conv": False, "it": 0, "valid": r["_k"] >= 2}
    key_schema = data.select(*keys).schema

    def evaluate_all(cands):
        rows = [tuple(list(k) + [list(map(float, b))]) for k, b in cands.items()]
        from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

        bs = StructType(list(key_schema.fields) + [StructField("beta", ArrayType(DoubleType()))])
        bdf = spark.createDataFrame(rows, bs)
        j = data.join(F.broadcast(bdf), keys)
        z = -F.col("y") * F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0),
                                      lambda acc, v: acc + v)
        t = loss_columns(j, None, p, tail, margin=z)
        x, w, y = F.col("x"), F.col("w"), F.col("y")
        aggs = [F.sum(w * F.col("_g")).alias("f"), F.count(F.lit(1)).alias("n")]
        aggs += [F.sum(-w * F.col("_gp") * y * x[i]).alias(f"g{i}") for i in range(d)]
        aggs += [F.sum(w * F.col("_h") * x[i] * x[jj]).alias(f"h{i}_{jj}") for i, jj in _triu(d)]
        out = {}
        for r in t.groupBy(*keys).agg(*aggs).collect():
            H = np.zeros((d, d))
            for i, jj in _triu(d):
                H[i, jj] = H[jj, i] = r[f"h{i}_{jj}"]
            out[tuple(r[c] for c in keys)] = (r["f"], np.array([r[f"g{i}"] for i in range(d)]), H, r["n"])
        return out

    first = evaluate_all({k: s["beta"] for k, s in state.items() if not s["done"]})
    for k, (f, g, H, n) in first.items():
        state[k].update(f=f, g=g, H=H, n=max(n, 1))
    for _ in range(max_iter * 4):
        active = {}
        for k, s in state.items():
            if s["done"]:
                continue
            if np.max(np.abs(s["g"])) / s["n"] < gtol or s["it"] >= max_iter:
                s["done"], s["conv"] = True, bool(np.max(np.abs(s["g"])) / s["n"] < 1e-5)
                continue
            if s["alpha"] == 1.0:
                Hs = 0.5 * (s["H"] + s["H"].T)
                mu = 1e-10 * max(np.trace(Hs) / d, 1e-300)
                step = -np.linalg.solve(Hs + mu * np.eye(d), s["g"])
                if float(s["g"] @ step) >= 0:
                    step = -s["g"]
                s["step"] = step
            s["cand"] = s["beta"] + s["alpha"] * s["step"]
            active[k] = s["cand"]
        if not active:
            break
        res = evaluate_all(active)
        for k, (f2, g2, H2, _) in res.items():
            s = state[k]
            slope = float(s["g"] @ s["step"])
            if np.isfinite(f2) and f2 <= s["f"] + 1e-4 * s["alpha"] * slope:
                rel = abs(s["f"] - f2) / max(1.0, abs(s["f"]))
                s.update(beta=s["cand"], f=f2, g=g2, H=H2, alpha=1.0, it=s["it"] + 1)
                if rel < 1e-15 and np.max(np.abs(g2)) / s["n"] < 1e-5:
                    s["done"], s["conv"] = True, True
            else:
                s["alpha"] = _backtrack(s["alpha"], s["f"], f2, slope)
                if s["alpha"] < 1e-18:
                    s["done"], s["conv"] = True, bool(np.max(np.abs(s["g"])) / s["n"] < 1e-5)
    rows = [tuple(list(k) + [list(map(float, s["beta"])) if s["valid"] else None, bool(s["conv"]), int(s["it"])])
            for k, s in state.items()]
    from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

    sch = StructType(list(key_schema.fields) + [StructField("beta", ArrayType(DoubleType())),
                                                StructField("converged", BooleanType()),
                                                StructField("iterations", IntegerType())])
    return spark.createDataFrame(rows, sch)
