import numpy as np
import pytest
from pyspark.sql import functions as F

from corelev.functions import random as R
from corelev.operators import sampling as SM
from corelev.sources.design import from_arrays

ROWS12 = [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10, 11, 12]]


def _ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_uniform_three_of_four(spark):
    df = from_arrays(spark, ROWS12, [1, 2, 4, 5])
    for seed in range(5):
        ids = _ids(SM.uniform_sample(df, 3, seed=seed))
        assert len(set(ids)) == 3 and set(ids) <= {0, 1, 2, 3}


@pytest.mark.parametrize("aug", [False, True])
def test_leverage_three_of_four(spark, aug):
    df = from_arrays(spark, ROWS12, [1, 2, 4, 5])
    core, _ = SM.leverage_coreset(df, 3, augmented=aug, round_up=False, d=3)
    rows = core.collect()
    assert len({r["id"] for r in rows}) == 3
    assert all(r["w"] > 0 for r in rows)


def test_sample_size_checks(spark):
    df = from_arrays(spark, np.zeros((5, 3)), np.ones(5))
    with pytest.raises(ValueError):
        SM.uniform_sample(df, 6)
    with pytest.raises(ValueError):
        SM.uniform_sample(df, 0)


def test_race_sample_equals_brute_force(spark, iris):
    X = iris[0]
    df = from_arrays(spark, X, np.ones(150)).withColumn("p", F.lit(1.0) / (F.col("id") + 1))
    tot = sum(1 / (i + 1) for i in range(150))
    df = df.withColumn("p", F.col("p") / tot)
    keys = df.select("id", (R.exponential("id", 3, "race") / F.col("p")).alias("k")).collect()
    brute = sorted(sorted(keys, key=lambda r: (r["k"], r["id"]))[i]["id"] for i in range(40))
    assert _ids(SM.weighted_sample(df, 40, "p", seed=3)) == brute
    assert _ids(SM.weighted_sample(df.repartition(7), 40, "p", seed=3)) == brute


def test_race_first_pick_law(spark):
    # P(first pick = i) = p_i for successive sampling
    p = np.array([0.5, 0.3, 0.15, 0.05])
    df = spark.createDataFrame([(i, float(p[i])) for i in range(4)], "id BIGINT, p DOUBLE")
    keys = df.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2999)))).withColumn("k", -F.log(R.uniform("id", 0, F.col("seed").cast("string"))) / F.col("p"))
    from pyspark.sql import Window
    first = keys.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("k"))).filter("r = 1")
    freq = {r["id"]: r["count"] / 3000 for r in first.groupBy("id").count().collect()}
    for i in range(4):
        assert abs(freq.get(i, 0) - p[i]) < 0.04


def test_multi_sample_nested(spark, iris):
    df = from_arrays(spark, iris[0], np.ones(150)).withColumn("p", F.lit(1 / 150))
    ranked = SM.multi_sample(df, [10, 20], [1, 2], "p", seed=0)
    ex = SM.expand_configs(ranked, [10, 20], "p").collect()
    by = {}
    for r in ex:
        by.setdefault((r["run"], r["size"]), set()).add(r["id"])
    assert all(len(v) == k for (_, k), v in by.items())
    assert by[(1, 10)] <= by[(1, 20)] and by[(1, 20)] != by[(2, 20)]


def test_reservoir_properties(spark, iris):
    X = iris[0]
    df = from_arrays(spark, X, np.ones(150)).withColumn("score", F.lit(1.0))
    assert len(_ids(SM.reservoir_sample(df, 150, d=4))) == 150
    assert len(_ids(SM.reservoir_sample(df, 1, d=4))) == 1
    ids = _ids(SM.reservoir_sample(df, 30, d=4))
    assert len(set(ids)) == 30 and set(ids) <= set(range(150))


def test_online_ridge_shapes(spark, iris):
    df = from_arrays(spark, iris[0], np.ones(150)).withColumn("g", F.lit(1))
    out = SM.online_ridge_sample(df, 20, "g", c=1 / 150, d=4).collect()
    assert len(out) == 20 and all(r["w"] == 1.0 for r in out)


def test_online_ridge_equals_the_row_by_row_rule(spark, iris):
    """Per key: weight min(x^T A^-1 x, 1) + c, first k kept, then k w / sum w; accepted rows enter A."""
    df = from_arrays(spark, iris[0], np.ones(150)).withColumn("g", F.col("id") % 2)
    k, c = 6, 0.02
    rows = df.select("g", "ord", "id", "x", R.uniform("id", 0, "res1").alias("u1"), R.uniform("id", 0, "res2").alias("u2")).toPandas()
    want = set()
    for g, part in rows.sort_values(["ord", "id"]).groupby("g"):
        A, total, held = 1e-6 * np.eye(4), 0.0, {}
        for i, r in enumerate(part.itertuples()):
            x = np.array(r.x)
            w = min(x @ np.linalg.solve(A, x), 1) + c
            total += w
            if i < k or r.u1 < k * w / total:
                held[i if i < k else int(r.u2 * k) % k] = r.id
                A = A + np.outer(x, x)
        want |= {(g, i) for i in held.values()}
    got = {(r["g"], r["id"]) for r in SM.online_ridge_sample(df, k, "g", c=c, d=4).collect()}
    assert got == want


def _sequential_reservoir(df, k, weight, key, seed):
    """Brute force: the sequential Chao scan over each key's (ord, id) order."""
    src = df.withColumn("_w", F.col(weight).cast("double")) \
        .withColumn("_u1", R.uniform("id", seed, "res1")).withColumn("_u2", R.uniform("id", seed, "res2"))
    pdf = src.toPandas().sort_values(["ord", "id"], kind="mergesort")
    out = set()
    for g, rows in (pdf.groupby(key) if key else [(0, pdf)]):
        held, total = {}, 0.0
        for i, (_, r) in enumerate(rows.iterrows()):
            total += r["_w"]
            if i < k or (total > 0 and r["_u1"] < k * r["_w"] / total):
                held[i if i < k else int(r["_u2"] * k) % k] = r["id"]
        out |= {(g, i) for i in held.values()}
    return out


def test_negative_weights_are_an_error(spark):
    df = spark.range(10).withColumn("p", F.when(F.col("id") == 3, -1.0).otherwise(1.0))
    with pytest.raises(ValueError):
        SM.weighted_sample(df, 2, "p")
    with pytest.raises(ValueError):
        SM.multi_sample(df, [2], [1], "p")


def test_multi_sample_one_pass_equals_histogram(spark, monkeypatch):
    df = spark.range(3000).withColumn("p", (F.col("id") % 5 + 1).cast("double"))
    key = lambda d: sorted((r["run"], r["rank"], r["id"]) for r in d.collect())
    a = key(SM.multi_sample(df, [20, 60], [1, 2, 3], "p"))
    monkeypatch.setattr(SM, "OVERSAMPLE", 1e9)  # the table then counts as small: every row is a candidate
    assert key(SM.multi_sample(df, [20, 60], [1, 2, 3], "p")) == a
    one = spark.range(400).withColumn("p", F.when(F.col("id") == 7, F.lit(1e9)).otherwise(F.lit(1.0)))
    b = key(SM.multi_sample(one, [30], [1, 2], "p"))
    monkeypatch.setattr(SM, "OVERSAMPLE", 3.0)
    assert key(SM.multi_sample(one, [30], [1, 2], "p")) == b


@pytest.mark.parametrize("block_rows", [None, 7, 40])
def test_parallel_reservoir_equals_sequential(spark, block_rows):
    rng = np.random.default_rng(5)
    n = 400
    # one hot key with most rows, a few small keys, ties in ord
    keys = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 6, n))
    rows = [(i, int(keys[i]), int(rng.integers(0, 50)), float(rng.exponential()) * (i % 9 != 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "id BIGINT, user_id INT, ord INT, wt DOUBLE").repartition(5)
    for k, key in [(5, "user_id"), (1, "user_id"), (12, None)]:
        got = SM.reservoir_sample(df, k, weight="wt", key=key, seed=3, block_rows=block_rows)
        got = {(r["user_id"] if key else 0, r["id"]) for r in got.collect()}
        assert got == _sequential_reservoir(df, k, "wt", key, 3)


def test_parallel_reservoir_keeps_columns(spark, iris):
    df = from_arrays(spark, iris[0], np.ones(150)).withColumn("score", F.col("id") + 1.0)
    out = SM.reservoir_sample(df, 10, d=4, block_rows=30)
    assert out.columns == df.columns and out.count() == 10


@pytest.mark.parametrize("topk_max,subs", [(1, 2), (10, 4), (60, 4)])
def test_large_k_selection_equals_top_k(spark, monkeypatch, topk_max, subs):
    # 3000 rows, k = 900: the boundary log-bucket holds far more than topk_max rows,
    # so the sub-bucket refinement runs (several rounds for the small settings)
    df = spark.range(3000).withColumn("p", (F.col("id") % 7 + 1).cast("double"))
    want = _ids(SM.weighted_sample(df, 900, "p", seed=5))
    monkeypatch.setattr(SM, "TOPK_MAX", topk_max)
    monkeypatch.setattr(SM, "SUB_BUCKETS", subs)
    got = SM.weighted_sample(df.repartition(3), 900, "p", seed=5)
    assert _ids(got) == want and got.count() == 900


def test_ordered_rank_equals_row_number(spark):
    from pyspark.sql import Window

    rng = np.random.default_rng(2)
    rows = [(i, int(g), float(v)) for i, (g, v) in enumerate(zip(np.where(rng.random(500) < 0.8, 1, rng.integers(2, 5, 500)),
                                                                  rng.integers(0, 40, 500)))]
    df = spark.createDataFrame(rows, "id BIGINT, run INT, _key DOUBLE").repartition(4)
    want = {r["id"]: r["rank"] for r in df.withColumn(
        "rank", F.row_number().over(Window.partitionBy("run").orderBy("_key", "id"))).collect()}
    got = {r["id"]: r["rank"] for r in SM.ordered_rank(df, "run", block_rows=17).collect()}
    assert got == want


def test_multi_sample_large_kmax_path(spark, monkeypatch):
    df = spark.range(2000).withColumn("p", (F.col("id") % 5 + 1).cast("double"))
    want = sorted((r["run"], r["rank"], r["id"]) for r in SM.multi_sample(df, [50, 300], [1, 2], "p").collect())
    monkeypatch.setattr(SM, "TOPK_MAX", 10)
    got = sorted((r["run"], r["rank"], r["id"]) for r in SM.multi_sample(df, [50, 300], [1, 2], "p").collect())
    assert got == want


def test_small_k_fallback_concentrated_weights(spark):
    # one row holds nearly all the weight: fewer than k rows pass 3k / sum(w),
    # so the histogram threshold is used; the sample must still be the k smallest keys
    df = spark.range(400).withColumn("p", F.when(F.col("id") == 7, F.lit(1e9)).otherwise(F.lit(1.0)))
    keys = df.select("id", (R.exponential("id", 2, "race") / F.col("p")).alias("k")).collect()
    brute = sorted(r["id"] for r in sorted(keys, key=lambda r: (r["k"], r["id"]))[:50])
    assert _ids(SM.weighted_sample(df, 50, "p", seed=2)) == brute
    spread = spark.range(400).withColumn("p", (F.col("id") % 3 + 1).cast("double"))
    keys = spread.select("id", (R.exponential("id", 2, "race") / F.col("p")).alias("k")).collect()
    brute = sorted(r["id"] for r in sorted(keys, key=lambda r: (r["k"], r["id"]))[:50])
    assert _ids(SM.weighted_sample(spread.repartition(5), 50, "p", seed=2)) == brute


def test_run_candidates_in_compiled_filters(spark):
    """Candidates are all (row, run) with a key up to the cut, and their plan has no lambda."""
    df = from_arrays(spark, np.random.default_rng(2).normal(size=(300, 2)), np.ones(300)).withColumn("p", F.col("id") % 7 + 1.0)
    few = SM._run_candidates(df, 3, [1, 2, 5], "p", 4, "s", 0.05)
    assert "lambda" not in few._jdf.queryExecution().logical().toString()
    want = []
    for r in (1, 2, 5):
        key = SM.race_key(F.col("p"), 4, F.lit(f"s:{r}"))
        want += [(x["id"], r, x["k"]) for x in df.select("id", key.alias("k")).collect() if x["k"] <= 0.05]
    assert sorted((x["id"], x["run"], x["_key"]) for x in few.collect()) == sorted(want)
    assert few.columns == [*df.columns, "run", "_key"]
    assert SM._run_candidates(df, 300, [1], "p", 4, "s", 0.05) is None
