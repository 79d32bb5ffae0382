"""Sparse rows: the same results as dense ones, and designs too wide to densify."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from corelev.operators import probit as P
from corelev.operators import scores as S
from corelev.operators import sparse as SP
from corelev.sources import files as FS
from corelev.sources.design import from_arrays


def _data(n=400, d=6, seed=0):
    r = np.random.default_rng(seed)
    X = r.normal(size=(n, d)) * (r.random((n, d)) < 0.4)
    X[:, -1] = 1.0
    X[3] = 0.0
    return X, np.where(X @ r.normal(size=d) + r.normal(size=n) > 0, 1.0, -1.0)


def test_scores_sketch_and_gram_equal_dense(spark):
    X, y = _data()
    dense = from_arrays(spark, X, y).repartition(5)
    sparse = SP.sparse_rows(dense)
    np.testing.assert_allclose(SP.gram(sparse, 6), X.T @ X, rtol=1e-10, atol=1e-10)
    a = {r["id"]: r["score"] for r in S.leverage_scores(dense, d=6).collect()}
    b = {r["id"]: r["score"] for r in SP.leverage_scores(sparse).collect()}
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)
    a = {(r["bucket"], r["j"]): r["value"] for r in S.countsketch_table(dense, 16, 6).collect() if abs(r["value"]) > 1e-12}
    b = {(r["bucket"], r["j"]): r["value"] for r in SP.countsketch(sparse, 16).collect() if abs(r["value"]) > 1e-12}
    assert a.keys() == b.keys() and all(abs(a[c] - b[c]) < 1e-9 for c in a)


@pytest.mark.parametrize("p", [1.0, 2.0])
def test_quasi_newton_finds_the_newton_optimum(spark, p):
    X, y = _data(seed=3)
    r = SP.fit(SP.sparse_rows(from_arrays(spark, X, y)), p, 6)
    want = P.np_fit(X, y, None, p)
    assert r.converged and abs(r.f - want.f) < 1e-6 * abs(want.f)
    np.testing.assert_allclose(r.beta, want.beta, atol=2e-4)


def test_lbfgs_wide_in_numpy():
    """d = 2,000, strongly convex with very different curvatures: the optimum, from d-vectors only."""
    r = np.random.default_rng(1)
    h, at = np.exp(r.uniform(-2, 2, 2000)), r.normal(size=2000)
    res = SP.lbfgs(lambda b: (0.5 * float(h @ (b - at) ** 2), h * (b - at), 1), 2000, 500, 1e-8)
    np.testing.assert_allclose(res.beta, at, atol=1e-6)


def test_one_class_is_an_error(spark):
    X, y = _data()
    with pytest.raises(ValueError):
        SP.fit(SP.sparse_rows(from_arrays(spark, X, np.ones(len(y)))), 2.0, 6)


def test_wide_libsvm_file_stays_sparse(spark, tmp_path):
    """100,000 columns: read, sketched, margins and a fit's pass without a dense row."""
    r = np.random.default_rng(2)
    lines, rows = [], []
    for i in range(200):
        idx = np.sort(r.choice(100_000, 5, replace=False))
        val = np.round(r.normal(size=5), 3)
        yv = 1 if r.random() < 0.5 else -1
        rows.append((yv, idx, val))
        lines.append(f"{'+1' if yv > 0 else '0'} qid:3 " + " ".join(f"{j + 1}:{v}" for j, v in zip(idx, val)) + (" # note 7:1" if i % 2 else ""))
    (tmp_path / "w.svm").write_text("\n".join([*lines, "", lines[0], "-1"]) + "\n")
    df = FS.read_libsvm_sparse(spark, str(tmp_path / "w.svm"))
    got = df.collect()
    assert len(got) == 202 and len({x["id"] for x in got}) == 202
    assert sorted((x["y"], tuple(x["idx"]), tuple(x["val"])) for x in got) == sorted(
        [(yv, tuple(i), tuple(v)) for yv, i, v in rows] + [(rows[0][0], tuple(rows[0][1]), tuple(rows[0][2])), (-1, (), ())])
    d = SP.width(df)
    assert d <= 100_000
    f, g, n = SP.loss_gradient(df.repartition(3), np.zeros(d), 2.0)
    want = np.zeros(d)
    for x in got:
        np.add.at(want, np.array(x["idx"], int), -x["y"] * np.sqrt(2 / np.pi) * np.array(x["val"], float))
    np.testing.assert_allclose(g, want, atol=1e-9)
    assert n == 202 and abs(f - 202 * np.log(2)) < 1e-9
    assert SP.countsketch(df, 8).agg(F.count("*")).first()[0] <= 1005


def test_empty(spark):
    none = spark.createDataFrame([], "id long, y int, w double, idx array<int>, val array<double>")
    assert SP.width(none) == 0 and SP.loss_gradient(none, np.zeros(3))[2] == 0 and SP.leverage_scores(none, 3).count() == 0


def test_sparse_text_parsed_in_arrow(spark, tmp_path):
    """Lines go through Arrow's kernels, not through lambdas and a regular expression a row; odd lines as SQL's casts read them."""
    text = ["1 1:2.5 3:-1e-05 # c 4:5", "", "  -1\t2:3  7:1 ", "\t1 1:2", "# x", "0 qid:3 1:2d +3:Infinity", "NaN", "2.0 5:1:4"]
    (tmp_path / "o.svm").write_text("\n".join(text) + "\n")
    df = FS.read_libsvm_sparse(spark, str(tmp_path / "o.svm"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan
    assert sorted((x["y"], x["w"], tuple(x["idx"]), tuple(x["val"])) for x in df.collect()) == sorted(
        [(1, 1.0, (0, 2), (2.5, -1e-05)), (-1, 1.0, (1, 6), (3.0, 1.0)), (-1, 1.0, (0, 2), (2.0, np.inf)), (1, 1.0, (), ()), (1, 1.0, (4,), (4.0,))])


@pytest.mark.parametrize("bad", ["1 :2", "1 1:", "x 1:2", "1 1.5:2", "1 3000000000:2"])
def test_sparse_text_wrong_numbers(bad):
    import pyarrow as pa

    with pytest.raises(ValueError):
        FS._parsed(pa.array([bad]))
