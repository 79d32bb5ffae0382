import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corelev.operators import preprocess as PP
from corelev.operators import sampling as SM
from corelev.operators import scores as S
from corelev.operators import summary as G
from corelev.sources import files as FL
from corelev.sources import recipes as RC
from corelev.sources.design import from_arrays


def test_csv_run_files_and_sinks(spark, tmp_path):
    for run in (1, 2):
        with open(tmp_path / f"toy_sample_uniform_run_{run}.csv", "w") as fh:
            fh.write("beta_0,beta_1,size\n")
            for i in range(3):
                fh.write(f"{run + i * 0.1},{-run},{10 * (i + 1)}\n")
    df = FL.read_run_files(spark, str(tmp_path / "toy_sample_uniform_run_*.csv"))
    assert sorted(r["run"] for r in df.select("run").distinct().collect()) == [1, 2]
    assert FL.read_csv(spark, str(tmp_path / "toy_sample_uniform_run_1.csv")).count() == 3
    out = str(tmp_path / "results")
    res = spark.createDataFrame([(1, 10, 1.1), (2, 10, 1.2)], "run INT, size INT, ratio DOUBLE")
    FL.append_with_run_offset(res, out)
    FL.append_with_run_offset(res, out)
    assert sorted(r["run"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_beta_store_and_materialize(spark, tmp_path):
    path = str(tmp_path / "betas")
    assert FL.load_beta(spark, path, "toy", 2.0) is None
    FL.save_beta(spark, path, "toy", 2.0, [0.5, -1.0, 2.0])
    np.testing.assert_allclose(FL.load_beta(spark, path, "toy", 2.0), [0.5, -1.0, 2.0])
    df = from_arrays(spark, np.eye(3), [1, -1, 1])
    m = FL.materialize(df, str(tmp_path / "design"))
    assert m.count() == 3
    assert FL.materialize(df).count() == 3


def test_libsvm_source(spark, tmp_path):
    p = tmp_path / "data.svm"
    p.write_text("1 1:0.5 3:2.0\n-1 2:1.5\n1 1:1.0 2:1.0 3:1.0\n")
    df = FL.read_libsvm(spark, str(p), num_features=3)
    rows = {tuple(r["x"]): (r["y"], r["id"]) for r in df.collect()}
    assert {k: v[0] for k, v in rows.items()} == {(0.5, 0.0, 2.0): 1, (0.0, 1.5, 0.0): -1, (1.0, 1.0, 1.0): 1}
    FL.write_libsvm(df, str(tmp_path / "back"))
    again = {tuple(r["x"]): (r["y"], r["id"]) for r in FL.read_libsvm(spark, str(tmp_path / "back"), num_features=3).collect()}
    assert again == rows  # ids come from the rows, not from the file's split


def test_lineitem_ids_are_unique(spark):
    from corelev.sources import tables as T

    for sf in ("sf0.001", "sf0.01"):
        li = T.table(spark, f"/root/testdata/{sf}", "lineitem")
        assert li.select(T.lineitem_id().alias("id")).distinct().count() == li.count()
        des = T.lineitem_design(spark, f"/root/testdata/{sf}")
        assert des.df.select("id").distinct().count() == des.n


def test_only_missing_paths_count_as_empty(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("not parquet")
    assert FL.max_run(spark, str(tmp_path / "none")) == 0
    with pytest.raises(Exception):
        FL.max_run(spark, str(tmp_path / "bad"))


def test_example_2d_and_recipes(spark):
    ex = RC.example_2d(spark)
    assert ex.count() == 175
    assert ex.filter(F.col("y") == 1).count() == 80
    cont = RC.COVERTYPE_CONTINUOUS
    rows = [tuple([i] + [float(i * (j + 1) % 7) for j in range(len(cont))] + [float(i % 2 == 0), 2 if i % 2 else 1])
            for i in range(20)]
    schema = ", ".join(["k INT"] + [f"{c} DOUBLE" for c in cont] + ["Soil_1 DOUBLE", "Cover_Type INT"])
    des = RC.covertype_design(spark.createDataFrame(rows, schema), "k")
    assert des.n_pos == 10 and des.d == len(cont) + 2
    assert des.features[-1] == "Soil_1" and "Soil_1" not in des.means
    ws = spark.createDataFrame([(i, float(i), 3.0, float(i == 2), float(i % 2)) for i in range(6)],
                               "k INT, a DOUBLE, c DOUBLE, one DOUBLE, LABEL DOUBLE")
    assert RC.webspam_design(ws, "k").features == ["a"]


def test_row_helpers(spark):
    b = spark.createDataFrame([("m", [1.0, 2.0, 3.0])], "method STRING, beta ARRAY<DOUBLE>")
    pts = PP.boundary_lines(b, -1.0, 1.0, steps=3).orderBy("x").collect()
    np.testing.assert_allclose([r["y"] for r in pts], [-(1 / 2) * x - 1.5 for x in (-1.0, 0.0, 1.0)])
    df = spark.createDataFrame([(i, i * 10) for i in range(5)], "idx INT, size INT")
    assert PP.filter_values(df, "size", [10, 30]).count() == 2
    assert df.select(PP.coefficient_index(F.lit("beta_7")).alias("j")).first()["j"] == 7


def test_lewis_variants_and_fraction_size(spark, iris):
    X = iris[0]
    df = from_arrays(spark, X, np.ones(150))
    for basis in ("exact", "sketch", "gauss"):
        s = [r["score"] for r in S.lewis_weights(df, T=3, d=4, n=150, basis=basis).collect()]
        assert len(s) == 150 and min(s) > 0
    core, _ = SM.lewis_coreset(df, 0.1, d=4, n=150)
    assert core.count() == 15
    with pytest.raises(ValueError):
        SM.coreset_size(1.5, 150)
    with pytest.raises(ValueError):
        S.lewis_weights(df, T=1, d=4, basis="foo")


def test_keyed_sample_is_per_key(spark):
    df = spark.createDataFrame([(i, i % 3, float(1 + i % 5)) for i in range(300)], "id BIGINT, g INT, w DOUBLE")
    out = SM.keyed_weighted_sample(df, 4, "w", "g").groupBy("g").count().collect()
    assert sorted(r["count"] for r in out) == [4, 4, 4]


def test_small_summaries(spark):
    df = spark.createDataFrame([(1, 10, 0.02, 1.0, 0.5), (1, 10, 0.07, 2.0, 0.7), (2, 20, 0.09, 3.0, 1.0)],
                               "run INT, k INT, eps DOUBLE, total_time_s DOUBLE, reduction_time_s DOUBLE")
    df = df.withColumn("p", F.lit(2.0))
    assert G.smallest_size_in_band(df).first()["min_k"] == 10
    assert G.metric_summary(df, ["k"], "eps").count() == 2
    assert G.medians(df, ["k"], ["eps"]).count() == 2
    r = G.draws_per_second(df, 100, 1000).first()["median_draws_per_s"]
    assert r > 0
    assert [x["k"] for x in G.distinct_values(df, "k").orderBy("k").collect()] == [10, 20]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_concurrent_appends_get_different_runs(spark, tmp_path, fmt):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "runs")

    def append(k):
        return FL.append_with_run_offset(spark.createDataFrame([(1, k), (2, k)], "run INT, writer INT"), path, fmt).select("run").collect()

    with ThreadPoolExecutor(4) as pool:
        claimed = [r["run"] for got in pool.map(append, range(6)) for r in got]
    assert len(set(claimed)) == 12
    back = spark.read.option("header", "true").format(fmt).load(path)
    assert sorted(r["run"] for r in back.collect()) == sorted(claimed)
    assert back.groupBy("writer").count().where("count = 2").count() == 6
    assert FL.max_run(spark, path, fmt) == max(claimed)


def test_claim_taken_meanwhile(spark, tmp_path):
    """A number that another writer has claimed but not yet written is passed over."""
    path = str(tmp_path / "runs")
    FL.append_with_run_offset(spark.createDataFrame([(1, "a")], "run INT, v STRING"), path)
    assert FL.claim_runs(spark, path, [1, 2]) == 1
    out = FL.append_with_run_offset(spark.createDataFrame([(1, "b")], "run INT, v STRING"), path)
    assert out.first()["run"] == 4
