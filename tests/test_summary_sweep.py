import pytest
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corelev.operators import summary as G
from corelev.plans import sweep as SW
from corelev.sources.design import Design, from_arrays


def test_sweep_summary_matches_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"size": np.repeat([10, 20, 30], 7), "ratio": rng.random(21) + 1,
                        "total_time_s": rng.random(21)})
    out = G.sweep_summary(spark.createDataFrame(pdf), ["size"]).toPandas().set_index("size").sort_index()
    for s, grp in pdf.groupby("size"):
        r = grp["ratio"]
        assert abs(out.loc[s, "median_ratio"] - r.median()) < 1e-12
        assert abs(out.loc[s, "std"] - r.std()) < 1e-12
        assert abs(out.loc[s, "mad"] - np.median(np.abs(r - r.median()))) < 1e-12
        assert abs(out.loc[s, "q75"] - np.quantile(r, 0.75)) < 1e-12
        assert abs(out.loc[s, "median_total_time_s"] - grp["total_time_s"].median()) < 1e-12


def test_config_grid(spark):
    assert SW.config_sizes(50, 100, 30) == [50, 80, 110]
    g = SW.config_grid(spark, 50, 100, 25, 3)
    assert g.count() == 9


def _iris_design(spark, iris):
    X, lab = iris
    Xs = (X - X.mean(0)) / X.std(0)
    X1 = np.hstack([Xs, np.ones((150, 1))])
    y = np.where(lab == 1, 1, -1)
    df = from_arrays(spark, X1, y)
    return Design(df, ["a", "b", "c", "d"], 150, int((y == 1).sum()), int((y == -1).sum()))


def test_sweep_runs_and_append(spark, iris, tmp_path):
    des = _iris_design(spark, iris)
    path = str(tmp_path / "res")
    for p in (1.0, 2.0, 3.0):
        res = SW.sweep(des, "leverage", p=p, sizes=[50, 75, 100], runs=[1, 2, 3], fast=False).collect()
        assert len(res) == 9
        assert all(r["ratio"] is None or r["ratio"] >= 0.99 for r in res)
        assert all(r["total_time_s"] > 0 for r in res)
    SW.sweep(des, "uniform", sizes=[50, 75, 100], runs=[1, 2, 3], results_path=path)
    SW.sweep(des, "uniform", sizes=[50, 75, 100], runs=[1, 2, 3], results_path=path)
    runs = sorted(r["run"] for r in spark.read.parquet(path).select("run").distinct().collect())
    assert runs == [1, 2, 3, 4, 5, 6]


def test_bayes_sweep_shape(spark, iris):
    des = _iris_design(spark, iris)
    out = SW.bayes_sweep(des, "uniform", sizes=[50, 100], runs=[1, 2], num_samples=100, burn_in=20)
    assert out.count() == 400
    cols = set(out.columns)
    assert {"run", "size", "reduction_time_s", "total_time_s", "beta_0", "beta_4"} <= cols


@pytest.mark.parametrize("q", [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0])
def test_select_quantile_equals_numpy(spark, q):
    from corelev.operators import summary as G

    rng = np.random.default_rng(11)
    n = 3000
    grp = rng.integers(0, 3, n)
    # heavy ties in group 0, continuous values elsewhere, some nulls
    val = np.where(grp == 0, rng.integers(0, 5, n).astype(float), rng.normal(size=n))
    rows = [(int(g), None if i % 97 == 0 else float(v)) for i, (g, v) in enumerate(zip(grp, val))]
    df = spark.createDataFrame(rows, "g INT, v DOUBLE").repartition(4)
    got = {r["g"]: r["_q"] for r in G.select_quantile(df, ["g"], "v", q).collect()}
    for k in range(3):
        vals = np.array([v for g, v in rows if g == k and v is not None])
        assert got[k] == pytest.approx(float(np.quantile(vals, q)), rel=1e-12, abs=1e-12)


def test_summaries_large_group_path(spark, monkeypatch):
    from corelev.operators import summary as G

    rng = np.random.default_rng(3)
    rows = [(int(s), float(v), float(t)) for s, v, t in zip(rng.integers(0, 2, 500), rng.normal(size=500),
                                                            rng.random(500))]
    df = spark.createDataFrame(rows, "size INT, ratio DOUBLE, total_time_s DOUBLE")
    exact = {r["size"]: r.asDict() for r in G.sweep_summary(df).collect()}
    five = {r["size"]: r.asDict() for r in G.five_number(df, ["size"], "ratio").collect()}
    monkeypatch.setattr(G, "EXACT_GROUP_LIMIT", 0)
    sel = {r["size"]: r.asDict() for r in G.sweep_summary(df).collect()}
    five_sel = {r["size"]: r.asDict() for r in G.five_number(df, ["size"], "ratio").collect()}
    for k in exact:
        for c in exact[k]:
            assert sel[k][c] == pytest.approx(exact[k][c], rel=1e-12, abs=1e-12)
        for c in five[k]:
            assert five_sel[k][c] == pytest.approx(five[k][c], rel=1e-12, abs=1e-12)


def test_size_search_returns_every_run(spark, iris):
    des = _iris_design(spark, iris)
    rows = SW.size_search(des, [1.0, 2.0], runs=[1, 2], lo=10, hi=140).collect()
    assert sorted((r["p"], r["run"]) for r in rows) == [(1.0, 1), (1.0, 2), (2.0, 1), (2.0, 2)]
    assert all(10 <= r["k"] <= 140 for r in rows)
    none = SW.size_search(des, 2.0, runs=[1], lo=20, hi=10).collect()
    assert [(r["run"], r["k"]) for r in none] == [(1, None)]


def test_size_search_same_result_beyond_the_task_limit(spark, iris, monkeypatch):
    des = _iris_design(spark, iris)
    a = SW.size_search(des, 2.0, runs=[1], lo=60, hi=140).collect()[0]
    monkeypatch.setattr(SW, "TASK_FIT_LIMIT", 5)
    b = SW.size_search(des, 2.0, runs=[1], lo=60, hi=140).collect()[0]
    assert a["k"] == b["k"] and abs(a["eps"] - b["eps"]) < 1e-6


def test_sweep_by_grid(spark, iris):
    des = _iris_design(spark, iris)
    got = SW.sweep(des, "uniform", grid=SW.config_grid(spark, 50, 100, 50, 2)).collect()
    assert sorted((r["run"], r["size"]) for r in got) == [(1, 50), (1, 100), (2, 50), (2, 100)]


def test_quantiles_of_large_groups_hold_no_sketch(spark, monkeypatch):
    """Ties, infinities, huge and tiny values and a null key; the plan counts buckets instead of merging sketches."""
    monkeypatch.setattr(G, "EXACT_GROUP_LIMIT", 0)
    monkeypatch.setattr(F, "percentile_approx", None)
    rng = np.random.default_rng(5)
    vals = {1: np.r_[rng.normal(size=400) * 10.0 ** rng.integers(-300, 300, 400), 0.0, -0.0], 2: rng.integers(0, 3, 301) / 100.0,
            None: np.nextafter(1.0, 2.0) + rng.integers(0, 9, 200) * 2.0 ** -52, 4: np.array([7.5])}
    rows = [(k, float(v)) for k, vs in vals.items() for v in vs] + [(5, None), (1, None), (6, np.inf), (6, 1.0), (6, -np.inf)]
    df = spark.createDataFrame(rows, "g INT, v DOUBLE").repartition(3)
    specs = [(f"q{i}", "v", q) for i, q in enumerate((0.0, 0.013, 0.5, 0.75, 1.0))] + [("a", F.abs("v"), 0.25)]
    for limit in (10_000, 0):
        monkeypatch.setattr(G, "LOCAL_BRACKETS", limit)
        got = {r["g"]: r for r in G.quantile_stats(df, ["g"], specs, [F.count("v").alias("n")]).collect()}
        assert set(got) == {1, 2, None, 4, 5, 6} and got[5]["q2"] is None and got[1]["n"] == 402
        assert [got[6][c] for c in ("q0", "q2", "q4")] == [-np.inf, 1.0, np.inf]
        for k, vs in vals.items():
            for i, q in enumerate((0.0, 0.013, 0.5, 0.75, 1.0)):
                assert got[k][f"q{i}"] == pytest.approx(np.quantile(np.sort(vs), q), rel=1e-12)
            assert got[k]["a"] == pytest.approx(np.quantile(np.abs(vs), 0.25), rel=1e-12)
