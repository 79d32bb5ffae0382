"""Sweeps as data.

A sweep over (size, run) configs is planned as a handful of Spark jobs instead of
one job per config:

1. scores -> probabilities on the design (once, persisted; C22);
2. one race-key sample per run, sizes nested inside a run (D8) - one histogram
   aggregate plus one window over ~runs x max(size) candidate rows;
3. all fits: one ``applyInPandas`` group per (run, size) (bounded k), or the
   lockstep distributed Newton for coresets above the task limit;
4. ONE evaluation job for all configs on the full data (E13);
5. append to the results table with a run offset (A8).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import posterior as PO
from ..operators import probit as P
from ..operators import sampling as SM
from ..operators import scores as S

TASK_FIT_LIMIT = 2_000_000


def config_sizes(min_size: int, max_size: int, step: int):
    """H1 sizes: arange(min, max + step, step) (may overshoot max)."""
    return list(range(int(min_size), int(max_size) + int(step), int(step)))


def config_grid(spark, min_size: int, max_size: int, step: int, num_runs: int) -> DataFrame:
    """H1: (run, size) grid."""
    sizes = config_sizes(min_size, max_size, step)
    return (spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"))
            .select(F.explode(F.sequence(F.lit(1), F.lit(num_runs))).alias("run"), "size")
            .select(F.col("run").cast("int"), F.col("size").cast("int")))


def score_design(design, method: str, p: float = 2.0, fast: bool = True, seed: int = 0,
                 online: bool = False) -> DataFrame:
    """Per-row (unnormalised) sampling weights ``score`` for a method.

    ``method`` may also be a callable ``design -> DataFrame`` returning the design
    rows with a non-negative ``score`` column (G12 user hook).
    """
    df, n, d = design.df, design.n, design.d
    if callable(method):
        out = method(design)
        if "score" not in out.columns:
            raise ValueError("a sampler hook must return a 'score' column")
        return out
    if method == "uniform":
        return df.withColumn("score", F.lit(1.0))
    if method == "leverage":
        if online:
            sc = S.online_leverage_scores(df, d=d, n=n)
        else:
            sc = S.leverage_scores(df, p=p, d=d, fast=fast, seed=seed, n=n)
        sc = sc.withColumn("score", S.round_up(S.augment(F.col("score"), n)))
    elif method == "lewis":
        sc = S.lewis_weights(df, fast=fast, d=d, n=n, seed=seed)
    elif method == "logit":
        sc = S.root_leverage_scores(df, d=d, n=n, seed=seed)
    else:
        raise ValueError(f"unknown method {method}")
    return sc


def sweep(design, method: str = "leverage", p: float = 2.0, sizes=(500,), runs=(1, 2, 3), seed: int = 0,
          fast: bool = True, online: bool = False, beta_opt=None, f_opt=None, results_path: str | None = None,
          tail: str = "exact", grid: DataFrame | None = None) -> DataFrame:
    """(run, size, ratio, sampling_time_s, total_time_s) for every config.

    Weights: uniform 1; importance methods 1 / (p size). Wall times are the batch
    times divided by the number of configs (every config is processed together).
    ``grid`` (run, size; e.g. ``config_grid``) names the configs instead of ``sizes`` x ``runs``.
    """
    if grid is not None:
        chosen = grid.select("run", "size").distinct().collect()  # the configs of one sweep
        sizes, runs = {r["size"] for r in chosen}, sorted({r["run"] for r in chosen})
    sizes = sorted(int(s) for s in sizes)
    runs = [int(r) for r in runs]
    df = design.df.persist()
    n, d = design.n, design.d
    if sizes[-1] > n:
        raise ValueError(f"the largest size, {sizes[-1]}, is above the design's {n} rows")
    t0 = time.perf_counter()
    scored = score_design(design, method, p, fast, seed, online).persist()
    tag = method if isinstance(method, str) else getattr(method, "__name__", "custom")
    ranked = SM.multi_sample(scored, sizes, runs, "score", seed, stream=f"sweep:{tag}")
    if method == "uniform":
        ranked = ranked.drop("p")
    ranked = ranked.persist()
    ranked.count()
    t1 = time.perf_counter()
    fits = fit_configs(ranked, sizes, p, d, tail).persist()
    fits.count()
    t2 = time.perf_counter()
    # the n-row scored table and the candidates are no longer needed once fits exist
    ranked.unpersist()
    scored.unpersist()
    if beta_opt is None:
        beta_opt = P.fit(df, p, d, check=False, tail=tail).beta
    ratios = P.approximation_ratio(df, fits.select("run", "size", "beta"), ["run", "size"], beta_opt, p, d,
                                   tail=tail, f_opt=f_opt)
    m = len(sizes) * len(runs)
    if grid is not None:
        ratios = ratios.join(grid.select("run", "size").distinct(), ["run", "size"], "left_semi")
    out = ratios.select(F.col("run").cast("int"), F.col("size").cast("int"), "ratio",
                        F.lit((t1 - t0) / m).alias("sampling_time_s"), F.lit((t2 - t0) / m).alias("total_time_s"))
    if results_path:
        from ..sources.files import append_with_run_offset

        out = out.persist()  # one row a config; written and returned
        append_with_run_offset(out, results_path)
    return out


def fit_configs(ranked: DataFrame, sizes, p: float, d: int, tail: str = "exact") -> DataFrame:
    """(run, size, beta) for nested coresets: one task per (run, size) when bounded, lockstep otherwise."""
    stacked = SM.expand_configs(ranked, sizes, "p", "importance" if "p" in ranked.columns else "none")
    stacked = stacked.drop("p") if "p" in stacked.columns else stacked
    return P.fit_groups(stacked, ["run", "size"], p, d, tail=tail, max_group_rows=TASK_FIT_LIMIT,
                        known_max_rows=max(sizes))


def sgd_sweep(design, p: float = 2.0, runs=(1,), seed: int = 0, beta_opt=None) -> DataFrame:
    """H5: one random-order SGD epoch per run (no reduction; size = 1 placeholder)."""
    df = design.df
    rows = []
    for r in runs:
        t0 = time.perf_counter()
        b = P.sgd_epoch(df, p, design.d, seed=seed + int(r))
        rows.append((int(r), 1, list(map(float, b)), time.perf_counter() - t0))
    spark = df.sparkSession
    betas = spark.createDataFrame(rows, "run INT, size INT, beta ARRAY<DOUBLE>, total_time_s DOUBLE")
    if beta_opt is None:
        beta_opt = P.fit(df, p, design.d, check=False).beta
    ratios = P.approximation_ratio(df, betas.select("run", "size", "beta"), ["run", "size"], beta_opt, p, design.d)
    return ratios.join(betas.select("run", "total_time_s"), "run").withColumn("sampling_time_s", F.lit(0.0))


def bayes_sweep(design, method: str = "uniform", sizes=(500,), runs=(1,), seed: int = 0,
                num_samples: int = 1000, burn_in: int = 100, prior_mean=None, prior_cov=None,
                online: bool = False, results_path: str | None = None) -> DataFrame:
    """Coreset -> posterior draws per (run, size), wide beta columns + timings."""
    sizes = sorted(int(s) for s in sizes)
    t0 = time.perf_counter()
    scored = score_design(design, method, 2.0, True, seed, online).persist()
    tag = method if isinstance(method, str) else getattr(method, "__name__", "custom")
    ranked = SM.multi_sample(scored, sizes, runs, "score", seed, stream=f"bayes:{tag}").persist()
    ranked.count()
    t1 = time.perf_counter()
    draws = PO.posterior_draws(ranked, ["run"], design.d, prior_mean, prior_cov, num_samples, 1, burn_in,
                               seed, prob_col="p", sizes=sizes).persist()
    draws.count()
    t2 = time.perf_counter()
    ranked.unpersist()
    scored.unpersist()
    m = len(sizes) * len(list(runs))
    out = PO.draws_wide(draws, design.d).withColumn("reduction_time_s", F.lit((t1 - t0) / m)) \
        .withColumn("total_time_s", F.lit((t2 - t0) / m))
    if results_path:
        from ..sources.files import write_runs

        write_runs(out, results_path)
    return out


def size_search(design, p=2.0, runs=(1,), lo: int = 100, hi: int | None = None,
                band=(0.05, 0.1), seed: int = 0) -> DataFrame:
    """Bisection per (p, run) for a coreset size with eps = ratio - 1 in ``band``.

    ``p`` is one value or a list. Each round evaluates the current k of every open run of a
    p together (one sample, fit and evaluation per round) and halves its interval, so the
    rounds end by themselves; every (p, run) gets exactly one row: the first size in the
    band, else the last one tried (k and the rest null if ``lo > hi`` from the start).
    Returns run, p, k, eps, beta_l2, beta_inf.
    """
    n, d = design.n, design.d
    df, own = _kept(design.df)
    rows = []
    for pv in ([p] if isinstance(p, (int, float)) else list(p)):
        beta_opt = P.fit(df, pv, d, check=False).beta
        f_opt = P.negative_log_likelihood(df, beta_opt, pv)
        scored = score_design(design, "leverage", pv, True, seed).persist()
        open_, last = {int(r): (lo, n if hi is None else hi) for r in runs}, {int(r): (None,) * 4 for r in runs}
        open_ = {r: v for r, v in open_.items() if v[0] <= v[1]}
        while open_:
            at = {r: (a + b) // 2 for r, (a, b) in open_.items()}
            ks = sorted(set(at.values()))
            ranked = SM.multi_sample(scored, ks, list(at), "score", seed, stream="search").persist()
            wanted = F.create_map(*[F.lit(v) for r, k in at.items() for v in (r, k)])[F.col("run")]
            stacked = (ranked.withColumn("size", wanted).filter(F.col("rank") <= F.col("size"))
                       .withColumn("w", F.lit(1.0) / (F.col("p") * F.col("size"))).drop("p"))
            fits = P.fit_groups(stacked, ["run", "size"], pv, d, max_group_rows=TASK_FIT_LIMIT,
                                known_max_rows=ks[-1]).persist()
            rat = P.approximation_ratio(df, fits.select("run", "size", "beta"), ["run", "size"], beta_opt, pv, d,
                                        f_opt=f_opt)
            dist = P.beta_distances(fits.filter(F.col("beta").isNotNull()), beta_opt, ["run", "size"])
            for r in rat.join(dist, ["run", "size"], "left").collect():
                run, k, eps = r["run"], r["size"], (r["ratio"] - 1.0) if r["ratio"] is not None else None
                a, b = open_.pop(run)
                last[run] = (k, eps, r["beta_l2"], r["beta_inf"])
                if eps is not None and band[0] <= eps <= band[1]:
                    continue
                a, b = (k + 1, b) if eps is None or eps > band[1] else (a, k - 1)
                if a <= b:
                    open_[run] = (a, b)
            ranked.unpersist()
            fits.unpersist()
        scored.unpersist()
        rows += [(r, float(pv), *v) for r, v in last.items()]
    if own:
        df.unpersist()
    return design.df.sparkSession.createDataFrame(rows, "run INT, p DOUBLE, k INT, eps DOUBLE, beta_l2 DOUBLE, beta_inf DOUBLE")


def _kept(df: DataFrame):
    """(df cached, whether this call cached it)."""
    own = not (df.storageLevel.useMemory or df.storageLevel.useDisk)
    return (df.persist() if own else df), own


def run_methods(design, p: float = 2.0, sizes=(500,), runs=(1, 2, 3), seed: int = 0) -> DataFrame:
    """Uniform, leverage and online-leverage sweeps, tagged by method."""
    beta_opt = P.fit(design.df.persist(), p, design.d, check=False).beta
    outs = []
    for name, kw in (("uniform", {"method": "uniform"}), ("leverage", {"method": "leverage"}),
                     ("leverage_online", {"method": "leverage", "online": True})):
        outs.append(sweep(design, p=p, sizes=sizes, runs=runs, seed=seed, beta_opt=beta_opt, **kw)
                    .withColumn("method", F.lit(name)))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out
