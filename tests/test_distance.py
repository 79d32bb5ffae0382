import numpy as np
from pyspark.sql import functions as F

from corelev.operators import distance as D


def _df(spark, A):
    return spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(A)], "id BIGINT, x ARRAY<DOUBLE>")


def test_mmd_properties(spark):
    rng = np.random.default_rng(0)
    a = rng.normal([1, 2, 3], 1, (1000, 3))
    b = rng.normal([1, 2, 3], 1, (1000, 3))
    shifted = rng.normal([2, 2, 3], 1, (1000, 3))
    wide = rng.normal([1, 2, 3], np.sqrt(2), (1000, 3))
    A = _df(spark, a)
    poly = lambda x: D.mmd_polynomial(A, _df(spark, x)).collect()[0]["mmd"]
    gauss = lambda x: D.mmd_gaussian_rff(A, _df(spark, x), features=512).collect()[0]["mmd"]
    assert D.mmd_polynomial(A, A).collect()[0]["mmd"] < 1e-6
    assert D.mmd_gaussian_rff(A, A).collect()[0]["mmd"] < 1e-9
    for f in (poly, gauss):
        assert f(shifted) > 0.1 and f(wide) > 0.1
    # exact identity against the brute-force V-statistic
    np.testing.assert_allclose(poly(b), D.mmd_exact_numpy(a, b, "polynomial"), rtol=1e-6)
    np.testing.assert_allclose(poly(shifted), D.mmd_exact_numpy(a, shifted, "polynomial"), rtol=1e-8)
    assert abs(gauss(shifted) - D.mmd_exact_numpy(a, shifted, "gaussian")) < 0.05


def test_kernels(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.0, 1.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    r = df.select(D.gaussian_kernel(F.col("a"), F.col("b")).alias("g"),
                  D.polynomial_kernel(F.col("a"), F.col("b")).alias("p")).collect()[0]
    assert abs(r["g"] - np.exp(-1.0)) < 1e-15 and r["p"] == 9.0


def test_grouped_distances(spark):
    rng = np.random.default_rng(3)
    ref = rng.normal(0, 1, (800, 3))
    grp = rng.normal(0.5, 2, (300, 3))
    R = _df(spark, ref)
    G = _df(spark, grp).withColumn("run", (F.col("id") % 3).cast("int"))
    nm = {r["run"]: r["norm"] for r in D.mean_distance_grouped(G, R, ["run"], col="x").collect()}
    mn = {r["run"]: r["matrix_norm"] for r in D.covariance_spectral_grouped(G, R, ["run"], col="x").collect()}
    mm = {r["run"]: r["mmd"] for r in D.mmd_polynomial_grouped(G, R, ["run"], col="x").collect()}
    for k in range(3):
        part = grp[np.arange(300) % 3 == k]
        np.testing.assert_allclose(nm[k], np.linalg.norm(part.mean(0) - ref.mean(0)), rtol=1e-10)
        np.testing.assert_allclose(mn[k], np.linalg.norm(np.cov(part, rowvar=False) - np.cov(ref, rowvar=False), 2),
                                   rtol=1e-8)
        np.testing.assert_allclose(mm[k], D.mmd_exact_numpy(part, ref, "polynomial"), rtol=1e-6)


def test_feature_map_hook_equals_polynomial(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, (300, 3)), rng.normal(0.3, 1.2, (200, 3))
    A, B = _df(spark, a), _df(spark, b)
    got = D.mmd_feature_map(A, B, lambda c: D.polynomial_features(c, 3)).collect()[0]["mmd"]
    np.testing.assert_allclose(got, D.mmd_exact_numpy(a, b, "polynomial"), rtol=1e-8)
