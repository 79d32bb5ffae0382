import numpy as np
import pytest
from pyspark.sql import functions as F

from corelev.operators import probit as P
from corelev.sources.design import DesignSpec, build_design, from_arrays, validate_design

TOY_X = [[1, 0], [0.1, 1], [-0.1, 1], [-1, 0], [0, -1]]
TOY_Y = [1, -1, -1, 1, -1]


def test_toy5_beta_opt(spark):
    df = from_arrays(spark, TOY_X, TOY_Y)
    r = P.fit(df, 2.0, 2)
    np.testing.assert_array_almost_equal(r.beta, [0, -0.4307273], decimal=4)
    assert validate_design(df) == {"n": 5, "d": 2, "n_pos": 2, "n_neg": 3}


def test_toy5_intercept_last(spark):
    X = np.hstack([np.array(TOY_X, float), np.ones((5, 1))])
    df = from_arrays(spark, X, TOY_Y)
    r = P.fit(df, 2.0, 3)
    np.testing.assert_array_almost_equal(r.beta, [0, -0.39382684, -0.19691342], decimal=4)


def test_build_design_standardises_population_sd(spark):
    rows = [(i, float(i), 5.0, float(i % 2), "a" if i % 3 else "b") for i in range(10)]
    df = spark.createDataFrame(rows, "k INT, a DOUBLE, c DOUBLE, z DOUBLE, lab STRING")
    spec = DesignSpec(id="k", features={"a": "a", "c": "c", "z": "z"}, label=F.col("lab") == "a",
                      standardize=["a", "c"])
    des = build_design(df, spec)
    x = np.array([r["x"] for r in des.df.orderBy("id").collect()])
    a = np.arange(10.0)
    np.testing.assert_allclose(x[:, 0], (a - a.mean()) / a.std())
    np.testing.assert_allclose(x[:, 1], 0.0)          # zero sd: centred, not divided
    np.testing.assert_allclose(x[:, 2], a % 2)        # not standardised
    np.testing.assert_allclose(x[:, 3], 1.0)          # intercept last
    assert des.d == 4 and des.n == 10


def test_drop_constant_and_single_nonzero(spark):
    rows = [(i, float(i), 1.0, 1.0 if i == 3 else 0.0, 1 if i % 2 else -1) for i in range(8)]
    df = spark.createDataFrame(rows, "k INT, a DOUBLE, const DOUBLE, one DOUBLE, y INT")
    spec = DesignSpec(id="k", features={"a": "a", "const": "const", "one": "one"}, label=F.col("y") == 1,
                      drop_constant=True, drop_single_nonzero=True)
    des = build_design(df, spec)
    assert des.features == ["a"] and des.d == 2
    spec.drop_single_nonzero = False
    assert build_design(df, spec).features == ["a", "one"]


def test_bad_inputs(spark):
    with pytest.raises(ValueError):
        from_arrays(spark, np.zeros((5, 3)), np.zeros(4))
    with pytest.raises(ValueError):
        from_arrays(spark, np.zeros(5), np.zeros(5))
    df = from_arrays(spark, [[1, 2], [3, 4]], [1, 0])
    with pytest.raises(ValueError):
        validate_design(df)
    df = from_arrays(spark, [[1, 2], [3, 4]], [1, 1])
    with pytest.raises(ValueError):
        validate_design(df)
    df = from_arrays(spark, [[1, 2], [3, 4]], [1, -1])
    with pytest.raises(ValueError):
        P.evaluate(df, [1.0, 2.0, 3.0], 2.0, d=2)


def test_cheap_rounding_is_the_rounding_of_sql(spark):
    from pyspark.sql import functions as F

    from corelev.session import configure
    from corelev.sources.design import rounded

    odd = "array(double('nan'), double('inf'), double('-inf'), -0.0D, -1e-9D, null, 1e300D, 0.5e-6D, -2.5e-6D, 1234567.1234565D)"
    df = spark.sql(f"SELECT explode({odd}) v").unionByName(spark.range(-5000, 5000).select(((F.col("id") * 10 + 5) / 1e7).alias("v")))
    df = df.unionByName(spark.range(5000).select(((F.rand(3) - 0.5) * F.pow(F.lit(10.0), (F.col("id") % 14 - 4).cast("double"))).alias("v")))
    r = df.select(rounded(F.col("v"), 6).alias("a"), F.round("v", 6).alias("b"))
    assert r.where("not (a <=> b) or cast(a as string) <> cast(b as string)").count() == 0
    configure(spark)  # wide plans must not stay with the JVM's interpreter
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
