import numpy as np
import pytest
from pyspark.sql import functions as F

from corelev.operators import scores as S
from corelev.sources.design import from_arrays

# fixed values: golden matrices and round-up vectors that results must equal
ROWS12 = [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10, 11, 12]]
ROWS12B = [[13, 2, 3], [4, 5, 6], [7, 8, 9], [10, 11, 12]]


def _scores(df, col="score"):
    return np.array([r[col] for r in df.orderBy("id").collect()])


def test_exact_leverage_pseudo_inverse(spark):
    df = from_arrays(spark, ROWS12, [1, 2, 4, 5])
    s = _scores(S.leverage_scores(df, d=3))
    np.testing.assert_allclose(s, [0.7, 0.3, 0.3, 0.7], atol=1e-9)
    assert abs(s.sum() - 2) < 1e-9     # = rank


def test_leverage_full_rank_matches_numpy(spark, iris):
    X, _ = iris
    df = from_arrays(spark, X, np.ones(150))
    Q, _ = np.linalg.qr(X)
    np.testing.assert_allclose(_scores(S.leverage_scores(df, d=4)), (Q ** 2).sum(1), rtol=1e-9)
    # p = 1: l1 norm of the QR basis rows (column signs do not matter)
    np.testing.assert_allclose(_scores(S.leverage_scores(df, p=1.0, d=4)), np.abs(Q).sum(1), rtol=1e-8)


def test_label_sign_invariance(spark):
    X = np.array(ROWS12B, float)
    y = np.array([1, -1, 1, -1])
    a = _scores(S.leverage_scores(from_arrays(spark, X, y), d=3))
    b = _scores(S.leverage_scores(from_arrays(spark, X * y[:, None], y), d=3))
    np.testing.assert_allclose(a, b, atol=1e-12)


@pytest.mark.parametrize("method", ["pinv", "solve"])
@pytest.mark.parametrize("block_rows", [1, 2, 1000])
def test_online_at_least_exact(spark, iris, method, block_rows):
    for X in (np.array(ROWS12B, float), iris[0]):
        df = from_arrays(spark, X, np.ones(len(X)))
        ex = _scores(S.leverage_scores(df, d=X.shape[1]))
        on = _scores(S.online_leverage_scores(df, d=X.shape[1], method=method, block_rows=block_rows))
        assert np.all(on >= ex - 1e-6)


def test_online_matches_sequential_loop(spark, iris):
    X = iris[0]
    df = from_arrays(spark, X, np.ones(150))
    on = _scores(S.online_leverage_scores(df, d=4, block_rows=37))
    M = np.zeros((4, 4))
    ref = []
    for x in X:
        M += np.outer(x, x)
        ref.append(min(max(x @ np.linalg.pinv(M) @ x, 0), 1))
    np.testing.assert_allclose(on, ref, atol=1e-8)


def test_online_invalid_method(spark):
    df = from_arrays(spark, ROWS12, [1, 2, 4, 5])
    with pytest.raises(ValueError):
        S.online_leverage_scores(df, d=3, method="foo")


def test_round_up(spark):
    vals = [0.1, 0.2, 0.25, 0.3, 0.4, 0.6, 0.8, 1, 2, 3, 5, 0, 0.0009765624]
    exp = [0.125, 0.25, 0.25, 0.5, 0.5, 1, 1, 1, 2, 4, 8, 0, 0.0009765625]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i INT, s DOUBLE")
    got = [r["r"] for r in df.select("i", S.round_up(F.col("s")).alias("r")).orderBy("i").collect()]
    np.testing.assert_array_equal(got, exp)
    neg = spark.createDataFrame([(0, -1.0)], "i INT, s DOUBLE")
    with pytest.raises(ValueError):
        S.check_nonnegative(neg, "s")


def test_probabilities_sum_to_one(spark, iris):
    df = from_arrays(spark, iris[0], np.ones(150))
    p = _scores(S.probabilities(S.leverage_scores(df, d=4), "score", "p"), "p")
    assert abs(p.sum() - 1) < 1e-12


def test_lewis_matches_numpy(spark, iris):
    X = iris[0]
    df = from_arrays(spark, X, np.ones(150))
    got = _scores(S.lewis_weights(df, T=20, d=4, n=150))
    w = np.ones(150)
    for _ in range(20):
        Xs = X / np.sqrt(w)[:, None]
        lev = np.einsum("ij,jk,ik->i", Xs, np.linalg.pinv(Xs.T @ Xs), Xs)
        w = np.sqrt(w * lev)
    np.testing.assert_allclose(got, w + 1 / 150, rtol=1e-7)
    fast = _scores(S.lewis_weights(df, T=5, fast=True, d=4, n=150))
    assert fast.shape == (150,) and np.all(fast > 0)


def test_sketch_scores_are_reasonable(spark, iris):
    X = iris[0]
    df = from_arrays(spark, X, np.ones(150))
    ex = _scores(S.leverage_scores(df, d=4))
    fa = _scores(S.leverage_scores(df, d=4, fast=True, n=150))
    assert np.all(fa > 0) and 0.2 < fa.sum() / ex.sum() < 5
    rt = _scores(S.root_leverage_scores(df, d=4, n=150))
    assert np.all(rt > 1 / 150)


def test_countsketch_is_linear_sum(spark, iris):
    X = iris[0]
    df = from_arrays(spark, X, np.ones(150))
    rows = {r["bucket"]: np.array(r["x"]) for r in S.sketch_rows(df, 16, 4).collect()}
    # the sum of all bucket rows with their signs equals sign-weighted column sums
    from corelev.functions import random as R
    sg = np.array([r["s"] for r in df.select("id", R.sign("id", 0, "cs:g").alias("s")).orderBy("id").collect()])
    np.testing.assert_allclose(sum(rows.values()), (sg[:, None] * X).sum(0), rtol=1e-12)
    cells = {(r["bucket"], r["j"]): r["value"] for r in S.countsketch_table(df, 16, 4).collect()}
    assert all(abs(cells[(b, j)] - v[j]) < 1e-9 for b, v in rows.items() for j in range(4))


@pytest.mark.parametrize("p", [1.0, 2.0, 5.0])
def test_sketch_basis_from_its_gram(spark, iris, p):
    """R from S^T S is the QR factor of the sketch, for every p; only d x d numbers are gathered."""
    df = from_arrays(spark, iris[0], np.ones(150))
    s = S.sketch_size(150, 4, p)
    A = np.array([r["x"] for r in S.sketch_rows(df, s, 4, p).collect()])
    R = np.linalg.qr(A, mode="r")
    R *= np.where(np.diag(R) < 0, -1.0, 1.0)[:, None]
    np.testing.assert_allclose(S.fast_basis(df, p, 4, n=150, jl_dim=None), np.linalg.inv(R), rtol=1e-6, atol=1e-9)


def test_exact_leverage_ill_conditioned(spark):
    r = np.random.default_rng(4)
    X = r.normal(size=(200, 3))
    X[:, 2] = X[:, 0] + X[:, 1] + 1e-7 * X[:, 2]
    assert np.linalg.cond(X) > 1e7
    Q, _ = np.linalg.qr(X)
    got = _scores(S.leverage_scores(from_arrays(spark, X, np.ones(200)).repartition(5), d=3))
    np.testing.assert_allclose(got, (Q ** 2).sum(1), atol=1e-6)
    got = _scores(S.leverage_scores(from_arrays(spark, X, np.ones(200)), p=1.0, d=3))
    np.testing.assert_allclose(got, np.abs(Q).sum(1), atol=1e-6)


def test_tsqr_tree(spark):
    from corelev.operators.linalg import tsqr

    X = np.random.default_rng(5).normal(size=(120, 4))
    R = tsqr(from_arrays(spark, X, np.ones(120)).repartition(9), 4, fan=2)
    np.testing.assert_allclose(R.T @ R, X.T @ X, rtol=1e-10)


def test_partition_invariance(spark, iris):
    df = from_arrays(spark, iris[0], np.ones(150))
    a = _scores(S.leverage_scores(df.repartition(1), d=4))
    b = _scores(S.leverage_scores(df.repartition(17), d=4))
    np.testing.assert_allclose(a, b, rtol=1e-12)
