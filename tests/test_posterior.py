import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from corelev.functions import random as R
from corelev.operators import posterior as PO
from corelev.operators import probit as P
from corelev.sources.design import from_arrays


def test_truncated_normal_bounds_and_mean():
    rng = np.random.default_rng(0)
    u = rng.random(200000)
    for mean, y in [(-3.0, 1.0), (0.0, -1.0), (1.5, 1.0), (40.0, -1.0), (-40.0, 1.0)]:
        z = PO.np_truncated_normal(np.full(len(u), mean), np.full(len(u), y), u)
        assert np.all(y * z >= 0)
        a = -y * mean  # standardised bound of y*(z - mean) > a
        if abs(mean) < 5:
            lam = math.exp(-a * a / 2) / math.sqrt(2 * math.pi) / (0.5 * math.erfc(a / math.sqrt(2)))
            assert abs(np.mean(y * (z - mean)) - lam) < 0.01


def test_quantile_inverts_cdf():
    from corelev.functions import pnormal as PN
    x = np.linspace(-30, 8, 500)
    lt = PN.ln_cdf_neg(-x, 2.0)
    np.testing.assert_allclose(PO.np_norm_ppf_log(lt), x, atol=1e-9)


def test_spark_column_draw_matches_numpy(spark):
    m = [-2.0, -0.3, 0.0, 0.8, 4.0, 12.0]
    rows = [(i, float(v), 1 if i % 2 else -1) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "id BIGINT, m DOUBLE, y INT").withColumn("u", R.uniform("id", 0, "t"))
    z = PO.truncated_normal_column(df, F.col("m"), F.col("y"), F.col("u"), "z").orderBy("id").collect()
    ref = PO.np_truncated_normal(np.array([r["m"] for r in z]), np.array([r["y"] for r in z], float),
                                 np.array([r["u"] for r in z]))
    np.testing.assert_allclose([r["z"] for r in z], ref, rtol=1e-9, atol=1e-9)


def test_gibbs_shapes_and_posterior_mean(spark, iris):
    X, lab = iris
    y = np.where(lab == 1, 1.0, -1.0)
    mle = P.np_fit(X, y, None, 2.0).beta
    draws = PO.gibbs_chain(X, y, mle, np.eye(4), num_samples=1500, burn_in=200, seed=1)
    assert draws.shape == (1500, 4)
    np.testing.assert_allclose(draws.mean(0), mle, atol=0.15)
    df = from_arrays(spark, X, y).withColumn("g", F.lit(1))
    out = PO.posterior_draws(df, ["g"], 4, num_samples=50, num_chains=2, burn_in=10).collect()
    assert len(out) == 100 and len(out[0]["beta"]) == 4


def test_augmentation_step_moment(spark, iris):
    X, lab = iris
    y = np.where(lab == 1, 1.0, -1.0)
    df = from_arrays(spark, X, y)
    z, b = PO.augmentation_step(df, np.zeros(4), 4)
    zs = np.array([r["z"] for r in z.orderBy("id").collect()])
    assert np.all(zs * y > 0)
    np.testing.assert_allclose(b, X.T @ zs, rtol=1e-10)


def test_truncated_normal_interval_bounds():
    rng = np.random.default_rng(3)
    n = 20000
    u = rng.random(n)
    # reference fixtures: (a, b, mean, sd) half-lines and intervals, and vector bounds at N(0, 1)
    for a, b, m, sd in [(0, np.inf, -3, 10), (-np.inf, 0, 0, 10), (1, 2, 1.5, 10), (1, 2, 0, 1),
                        (10, 11, 0, 1), (-11, -10, 0, 1), (-np.inf, -40, 0, 1)]:
        z = PO.np_truncated_normal_interval(a, b, m, sd, u)
        assert np.all(z >= a) and np.all(z <= b) and np.all(np.isfinite(z))
    z = PO.np_truncated_normal_interval(np.array([1, 10, 1.0]), np.array([2, 11, 2.0]), 0.0, 1.0, u[:3])
    assert np.all(z >= [1, 10, 1]) and np.all(z <= [2, 11, 2])
    # distribution check on a moderate interval: mean of N(0,1) on [-1, 2]
    z = PO.np_truncated_normal_interval(-1.0, 2.0, 0.0, 1.0, u)
    phi = lambda t: math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    Phi = lambda t: 0.5 * math.erfc(-t / math.sqrt(2))
    expect = (phi(-1) - phi(2)) / (Phi(2) - Phi(-1))
    assert abs(z.mean() - expect) < 0.02
    # half-line form agrees with the interval form
    hl = PO.np_truncated_normal(np.full(50, 0.7), np.ones(50), u[:50])
    iv = PO.np_truncated_normal_interval(0.0, np.inf, 0.7, 1.0, u[:50])
    np.testing.assert_allclose(hl, iv, rtol=1e-9, atol=1e-12)


def _two_class(n, d, seed):
    r = np.random.default_rng(seed)
    X = r.normal(size=(n, d))
    return X, np.where(X @ np.arange(1, d + 1) + r.normal(size=n) > 0, 1.0, -1.0)


def test_barrier_chain_equals_chain_in_one_task(spark):
    """Rows spread over 1 or 4 barrier tasks, over several stages: the same draws, and those of the plain chain."""
    X, y = _two_class(300, 3, 5)
    df = from_arrays(spark, X, y).repartition(3)
    args = (3, np.zeros(3), 10.0 * np.eye(3), 8, 2, "gibbs:x", 7, 300)
    old, PO.SEGMENT = PO.SEGMENT, 6
    try:
        got = [[r["beta"] for r in PO.gibbs_barrier(df, *args, tasks=t).orderBy("draw").collect()] for t in (1, 4)]
    finally:
        PO.SEGMENT = old
    assert got[0] == got[1] and len(got[0]) == 8
    want = PO.gibbs_chain(X, y, np.zeros(3), 10.0 * np.eye(3), 8, 2, seed=7, stream="gibbs:x", ids=[r["id"] for r in df.select("id").orderBy("id").collect()])
    np.testing.assert_allclose(got[0], want, atol=1e-9)


def test_large_groups_and_sizes_go_to_barrier_tasks(spark):
    """Groups and sizes above ``task_rows`` give the draws that small ones give; too large a size gives a null row."""
    X, y = _two_class(120, 2, 1)
    df = from_arrays(spark, X, y).withColumn("run", (F.col("id") % 3 == 0).cast("int")).withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy("id")))
    kw = dict(num_samples=2, num_chains=2, burn_in=1, seed=3)

    def draws(out, cols):
        return {tuple(r[c] for c in cols): r["beta"] for r in out.collect()}

    cols = ["run", "chain", "draw"]
    a, b = (draws(PO.posterior_draws(df, ["run"], 2, task_rows=t, **kw), cols) for t in (1000, 50))
    assert a.keys() == b.keys() and len(a) == 8 and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)
    cols = ["run", "size", "chain", "draw"]
    a, b = (draws(PO.posterior_draws(df, ["run"], 2, task_rows=t, sizes=[20, 40, 60], **kw), cols) for t in (1000, 30))
    assert a.keys() == b.keys() and (1, 60, 0, None) in a
    assert all((a[k] is None and b[k] is None) or np.allclose(a[k], b[k], atol=1e-9) for k in a)


def test_barrier_chain_reads_its_rows_in_chunks(spark, monkeypatch):
    """Rows in memory are bounded: no read is larger than CHUNK, and the draws stay those of the plain chain."""
    monkeypatch.setattr(PO, "CHUNK", 7)
    assert PO._reads([3, 3, 3, 16, 1]) == [([0, 1], [0, 3], 6), ([2], [0], 3), ([3], [0], 7), ([3], [0], 7), ([3, 4], [0, 2], 3)]
    monkeypatch.setattr(PO, "BLOCKS", 9)
    X, y = _two_class(300, 3, 5)
    df = from_arrays(spark, X, y).repartition(3)
    args = (3, np.zeros(3), 10.0 * np.eye(3), 3, 1, "gibbs:x", 7, 300)
    got = [[r["beta"] for r in PO.gibbs_barrier(df, *args, tasks=t).orderBy("draw").collect()] for t in (1, 4)]
    np.testing.assert_allclose(got[0], got[1], atol=1e-12)
    want = PO.gibbs_chain(X, y, np.zeros(3), 10.0 * np.eye(3), 3, 1, seed=7, stream="gibbs:x", ids=[r["id"] for r in df.select("id").orderBy("id").collect()])
    np.testing.assert_allclose(got[0], want, atol=1e-9)
