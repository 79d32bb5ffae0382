"""One coreset experiment end to end (the library call of SURVEY 3.2).

design -> scores -> coreset -> weighted fit on the coreset -> approximation ratio
f(beta_coreset) / f(beta_opt) on the full data.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import probit as P
from ..operators import sampling as SM


def coreset_ratio(design, k: int, p: float = 1.0, method: str = "leverage", seed: int = 0,
                  fast: bool = False, beta_opt=None) -> DataFrame:
    """Return one row: method, p, size, n, d, ratio, sampling_time_s, total_time_s, beta."""
    df = design.df.persist()
    n, d = design.n, design.d
    t0 = time.perf_counter()
    if method == "uniform":
        core = SM.uniform_sample(df, k, seed, n=n)
    elif method == "leverage":
        core, _ = SM.leverage_coreset(df, k, augmented=True, round_up=True, p=p, fast=fast,
                                      seed=seed, n=n, d=d)
    elif method == "lewis":
        core, _ = SM.lewis_coreset(df, k, fast=fast, seed=seed, n=n, d=d)
    elif method == "logit":
        core, _ = SM.root_leverage_coreset(df, k, seed=seed, n=n, d=d)
    else:
        raise ValueError(f"unknown method {method}")
    core = core.select("id", "x", "y", "w").withColumn("cfg", F.lit(0))
    core = core.persist()
    core.count()
    t1 = time.perf_counter()
    fits = P.fit_groups(core, ["cfg"], p, d, known_max_rows=k).persist()
    fits.count()
    t2 = time.perf_counter()
    if beta_opt is None:
        beta_opt = P.fit(df, p, d, check=False).beta
    ratio = P.approximation_ratio(df, fits.select("cfg", "beta"), ["cfg"], beta_opt, p, d)
    return (ratio.join(fits.select("cfg", "beta"), "cfg")
            .select(F.lit(method).alias("method"), F.lit(float(p)).alias("p"), F.lit(int(k)).alias("size"),
                    F.lit(int(n)).alias("n"), F.lit(int(d)).alias("d"), "ratio",
                    F.lit(t1 - t0).alias("sampling_time_s"), F.lit(t2 - t0).alias("total_time_s"),
                    "beta"))
