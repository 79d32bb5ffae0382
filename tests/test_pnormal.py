import math

import numpy as np
import pytest

from corelev.functions import pnormal as PN


def test_probit_matches_erfc():
    z = np.linspace(-30, 30, 601)
    lc = PN.ln_cdf_neg(z, 2.0)
    ref = np.array([math.log(0.5 * math.erfc(v / math.sqrt(2))) for v in z])
    np.testing.assert_allclose(lc, ref, rtol=1e-12, atol=1e-12)


def test_laplace_closed_form():
    z = np.linspace(-20, 20, 401)
    g, gp, _ = PN.np_loss_grad_hess(z, 1.0)
    ref = np.where(z >= 0, math.log(2) + z, -np.log1p(-0.5 * np.exp(z)))
    np.testing.assert_allclose(g, ref, rtol=1e-13)


@pytest.mark.parametrize("p", [1.0, 1.5, 2.0, 3.0, 5.0, 7.0])
def test_density_integrates_to_cdf(p):
    xs = np.linspace(-60, 1.1, 800001)
    num = np.trapezoid(PN.pdf(xs, p), xs)
    assert abs(num - PN.cdf(np.array([1.1]), p)[0]) < 1e-8


@pytest.mark.parametrize("p", [1.5, 2.0, 3.0, 4.0, 6.0])
def test_gradient_and_hessian_match_differences(p):
    z = np.array([-8, -2.5, -0.7, 0.3, 1.2, 3.0, 9.0])
    e = 1e-6
    g, gp, h = PN.np_loss_grad_hess(z, p)
    g2, gp2, _ = PN.np_loss_grad_hess(z + e, p)
    g1, gp1, _ = PN.np_loss_grad_hess(z - e, p)
    np.testing.assert_allclose((g2 - g1) / (2 * e), gp, rtol=1e-6, atol=1e-7)
    np.testing.assert_allclose((gp2 - gp1) / (2 * e), h, rtol=1e-5, atol=1e-6)


def test_finite_for_large_p_and_z():
    g, gp, h = PN.np_loss_grad_hess(np.array([5.0, 50.0, 500.0]), 6.0)
    assert np.all(np.isfinite(g)) and np.all(np.isfinite(gp))


def test_reference_tail_is_continuous():
    for p in (1.0, 2.0, 3.0):
        c = PN.cutoff(p)
        a, _, _ = PN.np_loss_grad_hess(np.array([c - 1e-9]), p, tail="reference")
        b, _, _ = PN.np_loss_grad_hess(np.array([c + 1e-9]), p, tail="reference")
        assert abs(a[0] - b[0]) < 1e-6


def test_sql_kernel_equals_numpy(spark):
    from pyspark.sql import functions as F

    z = [-7.0, -1.0, 0.0, 0.4, 2.2, 9.0]
    df = spark.createDataFrame([(v,) for v in z], "z DOUBLE")
    for p in (1.0, 2.0, 3.0):
        s = df.withColumn("s", F.expr(PN.sql_s("z", p))).withColumn("lc", F.expr(PN.sql_ln_cdf_neg("z", "s", p)))
        got = [r["lc"] for r in s.orderBy("z").collect()]
        np.testing.assert_allclose(got, PN.ln_cdf_neg(np.array(sorted(z)), p), rtol=1e-13)
