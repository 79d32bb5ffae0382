"""Posterior draws for probit (p = 2) by data augmentation.

F1 is re-aimed as a column draw: a half-line truncated normal by inverse CDF in
log space, x = Phi^-1(u * Phi(b)), with Phi^-1 from the Abramowitz-Stegun 26.2.23
start refined by Newton steps on ln Phi. One hash uniform per row and step, so a
draw is a pure function of (id, step, seed) - no rejection loop.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pnormal as PN
from ..functions import random as R
from ..functions.exprs import NP, SqlOps
from .linalg import dot_expr
from .moments import gram

NEWTON_STEPS = 3
LN_HALF = math.log(0.5)

# fixed values: Abramowitz & Stegun 26.2.23 rational start for the normal quantile
AS_C = (2.515517, 0.802853, 0.010328)
AS_D = (1.432788, 0.189269, 0.001308)


def _as_start(lq, ops):
    """x0 <= 0 with Phi(x0) ~= q for q <= 1/2, from ln q."""
    r = ops.sqrt(-2.0 * lq)
    num = AS_C[0] + r * (AS_C[1] + r * AS_C[2])
    den = 1.0 + r * (AS_D[0] + r * (AS_D[1] + r * AS_D[2]))
    return -(r - num / den)


def _newton_step(x, lq, ops):
    """x - (ln Phi(x) - ln q) / (phi(x) / Phi(x))."""
    lphi = PN.ln_cdf_neg(-x, 2.0, ops)
    ratio = ops.exp(-0.5 * x * x - 0.5 * math.log(2 * math.pi) - lphi)
    return x - (lphi - lq) / ratio


def np_norm_ppf_log(lt: np.ndarray) -> np.ndarray:
    """Phi^-1(exp(lt)) for lt <= 0 (numpy)."""
    lt = np.asarray(lt, dtype=float)
    with np.errstate(all="ignore"):
        lower = lt <= LN_HALF
        lq = np.where(lower, lt, np.log(-np.expm1(lt)))
        lq = np.minimum(lq, LN_HALF)
        x = _as_start(lq, NP)
        for _ in range(NEWTON_STEPS):
            x = _newton_step(x, lq, NP)
    return np.where(lower, x, -x)


def np_truncated_normal(mean: np.ndarray, y: np.ndarray, u: np.ndarray) -> np.ndarray:
    """z ~ N(mean, 1) truncated to z > 0 (y = +1) or z < 0 (y = -1)."""
    lt = np.log(u) + PN.ln_cdf_neg(-y * mean, 2.0)
    return mean - y * np_norm_ppf_log(lt)


def np_truncated_normal_interval(a, b, mean, std, u) -> np.ndarray:
    """F1 (general form): N(mean, std^2) restricted to [a, b] by inverse CDF in log space.

    With alpha, beta the standardised bounds, intervals in the upper half are mirrored
    to the lower half; there x = Phi^-1(Phi(alpha) + u (Phi(beta) - Phi(alpha))) is
    evaluated as ln Phi(beta) + ln(u + (1 - u) exp(ln Phi(alpha) - ln Phi(beta))), so
    far tails (e.g. [10, 11] under N(0, 1)) stay exact. Infinite bounds are allowed.
    """
    a, b, mean, std, u = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, mean, std, u)))
    alpha, beta = (a - mean) / std, (b - mean) / std
    flip = (alpha + beta) > 0            # interval mostly above the mean: mirror it
    lo = np.where(flip, -beta, alpha)
    hi = np.where(flip, -alpha, beta)
    with np.errstate(all="ignore"):
        l_lo = np.where(np.isneginf(lo), -np.inf, PN.ln_cdf_neg(-lo, 2.0))
        l_hi = np.where(np.isposinf(hi), 0.0, PN.ln_cdf_neg(-hi, 2.0))
        lt = l_hi + np.log(u + (1.0 - u) * np.exp(l_lo - l_hi))
        x = np_norm_ppf_log(np.minimum(lt, 0.0))
    x = np.clip(x, lo, hi)
    return mean + std * np.where(flip, -x, x)


def truncnorm_stages(mean_col: str, y_col: str, u_col: str, out: str, dialect: str = "spark"):
    """F1 as a list of (column, SQL) stages: out ~ N(mean, 1) restricted to sign(out) = y.

    The same stages run in Spark (``withColumn(c, F.expr(sql))``) and as chained
    CTEs in the DuckDB oracle.
    """
    ops = SqlOps(dialect)
    m, y, u = ops.col(mean_col), ops.col(y_col), ops.col(u_col)
    st = [("_tb", (y * m).sql)]
    st.append(("_tlt", (ops.ln(u) + PN.ln_cdf_neg(-ops.col("_tb"), 2.0, ops)).sql))
    lt = ops.col("_tlt")
    low = lt <= LN_HALF
    st.append(("_tlq", ops.least(ops.where(low, lt, ops.ln(-ops.expm1(lt))), LN_HALF).sql))
    lq = ops.col("_tlq")
    st.append(("_tx", _as_start(lq, ops).sql))
    for _ in range(NEWTON_STEPS):
        st.append(("_tx", _newton_step(ops.col("_tx"), lq, ops).sql))
    q = ops.where(low, ops.col("_tx"), -ops.col("_tx"))
    st.append((out, (m - y * q).sql))
    return st


def truncated_normal_column(df: DataFrame, mean: Column, y: Column, u: Column, out: str) -> DataFrame:
    """F1 as Spark columns: out ~ N(mean, 1) restricted to sign(out) = y."""
    t = (df.withColumn("_tm", mean.cast("double")).withColumn("_ty", y.cast("double"))
         .withColumn("_tu", u))
    for name, sql in truncnorm_stages("_tm", "_ty", "_tu", out, "spark"):
        t = t.withColumn(name, F.expr(sql))
    return t.drop("_tm", "_ty", "_tu", "_tb", "_tlt", "_tlq", "_tx")


def augmentation_step(df: DataFrame, beta, d: int, step: int = 0, seed: int = 0,
                      factor: Column | None = None):
    """one data-augmentation step on a design table.

    latent z_i ~ N(x_i.beta, 1) truncated by y_i (a projection), then the moment
    X^T (f z) (one aggregate). Returns (draws DataFrame, moment vector).
    """
    u = R.uniform("id", seed, F.lit(f"gibbs:{step}"))
    z = truncated_normal_column(df, dot_expr(F.col("x"), beta), F.col("y"), u, "z")
    f = factor if factor is not None else F.lit(1.0)
    _, b = gram(z, d, weight=f, vector="z")
    return z, b


class Chain:
    """F3's law for one group: prior, precision A = C C^T with C^-1, and its normals, a function of (stream, seed, step).

    beta = A^-1 (P0 m0 + b) + C^-T e, with b = X^T (f z) of this step and e standard normal: C^-T e has covariance A^-1.
    """

    def __init__(self, gram_f: np.ndarray, prior_mean, prior_cov, stream: str, seed: int):
        self.d = len(gram_f)
        P0 = np.linalg.inv(prior_cov)
        A = P0 + gram_f
        self.Ci = np.linalg.inv(np.linalg.cholesky(0.5 * (A + A.T)))
        self.pm = P0 @ np.asarray(prior_mean, dtype=float)
        self.base = np.array([[R.counter_base(f"e{j}#{h}", stream, seed) for j in range(self.d)] for h in (1, 2)], np.uint64)

    def step(self, t: int, b: np.ndarray) -> np.ndarray:
        u1, u2 = R.np_counter_uniform(self.base, t)
        e = np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * math.pi * u2)
        return self.Ci.T @ (self.Ci @ (self.pm + b) + e)


def latent_bases(ids, stream: str, seed: int) -> np.ndarray:
    return np.array([R.counter_base(i, stream, seed) for i in ids], np.uint64)


def gibbs_chain(X, y, prior_mean, prior_cov, num_samples, burn_in=100, probabilities=None,
                seed=0, stream="gibbs:0", ids=None):
    """F3 for one coreset in numpy (bounded k): draws after burn-in (num_samples x d).

    A row's uniforms are a function of its id, ``stream``, ``seed`` and the step (``ids``: its position if not given).
    """
    X = np.asarray(X, dtype=float)
    y = np.asarray(y, dtype=float)
    n, d = X.shape
    prob = np.full(n, 1.0 / n) if probabilities is None else np.asarray(probabilities, dtype=float)
    fsq = 1.0 / (prob * n)
    chain = Chain(X.T @ (X * fsq[:, None]), prior_mean, prior_cov, stream, seed)
    base = latent_bases(range(n) if ids is None else ids, stream, seed)
    beta, out = np.zeros(d), np.empty((num_samples, d))
    for t in range(num_samples + burn_in):
        z = np_truncated_normal(X @ beta, y, R.np_counter_uniform(base, t))
        beta = chain.step(t, X.T @ (z * fsq))
        if t >= burn_in:
            out[t - burn_in] = beta
    return out


BLOCKS = 256        # blocks of rows whose sums are added in their order, however many tasks hold them
SEGMENT = 250       # steps of a barrier stage, after which its draws are written
CHUNK = 65_536      # rows of a task in memory at a time


def _reads(sizes) -> list:
    """Blocks of ``sizes`` rows as reads of at most CHUNK rows: (positions of the blocks, their first rows, rows).

    A block is cut at multiples of CHUNK from its own start, so its sum doesn't depend on the blocks beside it.
    """
    out = []
    for i, size in enumerate(sizes):
        for first in range(0, size, CHUNK):
            m = min(CHUNK, size - first)
            if not out or out[-1][2] + m > CHUNK or out[-1][0][-1] == i:
                out.append(([], [], 0))
            at, starts, n = out.pop()
            out.append((at + [i], starts + [n], n + m))
    return out


def gibbs_barrier(rows: DataFrame, d: int, prior_mean, prior_cov, num_samples: int, burn_in: int, stream: str,
                  seed: int, n: int, prob_col: str | None = None, tasks: int | None = None) -> DataFrame:
    """F3 for a group of any size: (draw, beta). ``rows``: (id, x, y[, p]); ``n``: their number.

    The rows are dealt to ``tasks`` barrier tasks by block and stay there as arrays in a task's own temporary file, of which
    at most ``CHUNK`` rows are in memory. In each step a task draws its rows' latent variables and sums X^T (f z) by
    block; the tasks exchange these d-vectors, add all blocks in order and compute the same next beta. So draws don't depend on the number of tasks. A stage takes ``SEGMENT`` steps and
    its draws are written, so a lost executor costs at most that; the next stage goes on from the last beta.
    """
    from functools import reduce

    from pyspark import StorageLevel

    from ..session import scratch_path

    spark = rows.sparkSession
    tasks = min(BLOCKS, tasks or spark.sparkContext.defaultParallelism)
    p = F.col(prob_col).cast("double") if prob_col else F.lit(1.0 / n)
    rows = rows.select(F.col("id").cast("string").alias("id"), "x", F.col("y").cast("double").alias("y"), (1.0 / (p * F.lit(float(n)))).alias("f"))
    gram_f = gram(rows, d, weight="f")
    chain = Chain(gram_f, prior_mean, prior_cov, stream, seed)
    block = F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int")
    dealt = (rows.withColumn("block", block).repartition(tasks, F.col("block") % tasks)
             .sortWithinPartitions("block", "id").persist(StorageLevel.MEMORY_AND_DISK))
    dealt.count()

    def stage(first: int, last: int, beta0):
        def run(batches):
            import base64
            import json
            import os
            import tempfile

            import pyarrow as pa
            from pyspark import BarrierTaskContext

            from .moments import _batch_matrix

            ctx = BarrierTaskContext.get()
            kept, sizes = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None), {}
            for b in batches:  # a row: x, y, f, its random base
                if b.num_rows:
                    base = latent_bases(b.column("id").to_pylist(), stream, seed)
                    kept.write(np.column_stack([_batch_matrix(b, "x", d), b.column("y").to_numpy(), b.column("f").to_numpy(), base.view(np.float64)]).tobytes())
                    for v, m in zip(*np.unique(b.column("block").to_numpy(), return_counts=True)):
                        sizes[int(v)] = sizes.get(int(v), 0) + int(m)
            blocks, reads = np.array(sorted(sizes), int), _reads([sizes[v] for v in sorted(sizes)])
            beta, drawn = np.asarray(beta0, float), []
            for t in range(first, last):
                sums = np.zeros((len(blocks), d))
                kept.seek(0)
                for at, starts, m in reads:
                    rows_ = np.frombuffer(kept.read(m * (d + 3) * 8)).reshape(m, d + 3)
                    X, y, f = rows_[:, :d], rows_[:, d], rows_[:, d + 1]
                    u = R.np_counter_uniform(np.ascontiguousarray(rows_[:, d + 2]).view(np.uint64), t)
                    z = np_truncated_normal(X @ beta, y, u)
                    sums[at] += np.add.reduceat(X * (z * f)[:, None], starts, axis=0)
                said = json.dumps([blocks.astype(int).tolist(), base64.b64encode(sums.tobytes()).decode()])
                table = np.zeros((BLOCKS, d))
                for at, data in map(json.loads, ctx.allGather(said)):
                    table[at] = np.frombuffer(base64.b64decode(data)).reshape(-1, d)
                beta = chain.step(t, table.sum(axis=0))
                drawn.append((t, beta))
            if ctx.partitionId() == 0:
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in drawn], pa.int32()), pa.array([v.tolist() for _, v in drawn], pa.list_(pa.float64()))],
                                                 names=["step", "beta"])

        path = scratch_path(spark, "gibbs")
        dealt.mapInArrow(run, "step int, beta array<double>", barrier=True).write.parquet(path)
        return spark.read.schema("step int, beta array<double>").parquet(path)

    beta, done, total = np.zeros(d), [], num_samples + burn_in
    for first in range(0, total, SEGMENT):
        last = min(total, first + SEGMENT)
        done.append(stage(first, last, beta))
        beta = np.asarray(done[-1].where(F.col("step") == last - 1).first()["beta"])
    dealt.unpersist()
    return reduce(DataFrame.unionByName, done).where(F.col("step") >= burn_in).select((F.col("step") - burn_in).alias("draw"), "beta")


def posterior_draws(df: DataFrame, group_cols, d: int, prior_mean=None, prior_cov=None,
                    num_samples: int = 1000, num_chains: int = 1, burn_in: int = 100, seed: int = 0,
                    prob_col: str | None = None, sizes=None, task_rows: int = 500_000) -> DataFrame:
    """chains per group. Rows: group cols, [size], chain, draw, beta ARRAY<DOUBLE>.

    With ``sizes`` the group holds ranked coreset rows and one posterior is drawn per size on ``rank <= size``; a size
    above the group's rows gives one row with a null draw and beta. Groups (or sizes) of up to ``task_rows`` rows are
    chains inside one task each; each larger one is a job of barrier tasks (``gibbs_barrier``). Both give the same
    draws up to the order in which rows are summed: the randomness of a chain is a function of the row's id and of
    '<group values>:<size>:<chain>'.
    """
    import pandas as pd

    prior_mean = np.zeros(d) if prior_mean is None else np.asarray(prior_mean, dtype=float)
    prior_cov = 10.0 * np.eye(d) if prior_cov is None else np.asarray(prior_cov, dtype=float)
    gcols = list(group_cols)
    size_list = sorted(int(s) for s in sizes) if sizes is not None else [None]
    sel = gcols + ["id", "x", "y"] + ([prob_col] if prob_col else []) + (["rank"] if sizes is not None else [])
    rows = df.select(*sel)
    few = [s for s in size_list if s is None or s <= task_rows]
    large = [s for s in size_list if s is not None and s > task_rows]
    counts = rows.groupBy(*gcols).count()
    groups = counts.collect() if large else counts.where(F.col("count") > task_rows).collect() if None in few else []
    name = lambda key, s, ch: "gibbs:" + ":".join(map(str, [*key, "all" if s is None else s, ch]))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in gcols) + (", size INT" if sizes is not None else "") + ", chain INT, draw INT, beta ARRAY<DOUBLE>"

    def kernel(pdf):
        key, ch = [pdf[c].iloc[0] for c in gcols], int(pdf["chain"].iloc[0])
        pdf = pdf.sort_values(["rank", "id"] if sizes is not None else ["id"], kind="mergesort")
        X = np.stack(pdf["x"].to_numpy()).astype(float).reshape(-1, d)
        y, ids = pdf["y"].to_numpy().astype(float), pdf["id"].astype(str).tolist()
        pr = pdf[prob_col].to_numpy().astype(float) if prob_col else None
        frames = []
        for s in few:
            m = len(y) if s is None else s
            if m > len(y):  # the group is smaller than this size: one row without a draw
                got = pd.DataFrame({"draw": pd.array([None], dtype="Int32"), "beta": [None]})
            else:
                draws = gibbs_chain(X[:m], y[:m], prior_mean, prior_cov, num_samples, burn_in,
                                    None if pr is None else pr[:m], seed, name(key, s, ch), ids[:m])
                got = pd.DataFrame({"draw": np.arange(num_samples, dtype=np.int32), "beta": list(draws)})
            for c, v in zip(gcols, key):
                got[c] = v
            if s is not None:
                got["size"] = np.int32(s)
            got["chain"] = np.int32(ch)
            frames.append(got)
        return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(
            columns=gcols + (["size"] if sizes is not None else []) + ["chain", "draw", "beta"])

    small = rows.where(F.col("rank") <= F.lit(few[-1] if few else 0)) if large else rows
    if sizes is None and groups:  # the large groups leave the tasks
        keys = df.sparkSession.createDataFrame([tuple(r[c] for c in gcols) for r in groups], ", ".join(f"`{c}` {types[c]}" for c in gcols))
        small = rows.join(F.broadcast(keys), gcols, "left_anti")
    chains = small.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(num_chains - 1))))
    out = chains.groupBy(*gcols, "chain").applyInPandas(kernel, schema)
    for r in groups:
        key = [r[c] for c in gcols]
        own = rows
        for c, v in zip(gcols, key):
            own = own.where(F.col(c).eqNullSafe(F.lit(v)))
        for s in large or [None]:
            for ch in range(num_chains):
                m = r["count"] if s is None else s
                if m > r["count"]:
                    part = df.sparkSession.range(1).select(F.lit(None).cast("int").alias("draw"), F.lit(None).cast("array<double>").alias("beta"))
                else:
                    part = gibbs_barrier(own if s is None else own.where(F.col("rank") <= s), d, prior_mean, prior_cov, num_samples, burn_in,
                                         name(key, s, ch), seed, m, prob_col)
                part = part.withColumns({c: F.lit(v).cast(types[c]) for c, v in zip(gcols, key)} | {"chain": F.lit(ch)})
                out = out.unionByName(part.withColumn("size", F.lit(s)) if s is not None else part)
    return out


def draws_wide(draws: DataFrame, d: int) -> DataFrame:
    """beta ARRAY -> beta_0..beta_{d-1} (the reference's posterior table layout)."""
    keep = [c for c in draws.columns if c != "beta"]
    return draws.select(*keep, *[F.col("beta")[j].alias(f"beta_{j}") for j in range(d)])
