"""The p-generalised normal distribution and the p-probit loss.

Density with scale p^(1/p):   phi_p(x) = p^(1-1/p) / (2 Gamma(1/p)) * exp(-|x|^p / p)
CDF:                          Phi_p(x) = 1/2 + 1/2 sgn(x) P(1/p, |x|^p / p)
Loss:                         g(z)  = -ln Phi_p(-z)
Derivative:                   g'(z) = phi_p(z) / Phi_p(-z)
Second derivative:            g''(z) = g'(z) (g'(z) - sgn(z) |z|^(p-1))

P / Q are the regularised lower / upper incomplete gamma functions. Everything is
evaluated in log space through ln Q(a, s): a 30-term series of P for s < a + 1 and
a 40-level continued fraction otherwise, so the loss is finite for every z and p.
p = 1 has Q(1, s) = exp(-s) exactly.

All kernels take an ``ops`` object (``SqlOps`` -> SQL text for ``F.expr`` and the
DuckDB oracle, ``NP`` -> numpy arrays inside Arrow tasks).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from .exprs import NP, SqlOps

SERIES_TERMS = 30
CF_DEPTH = 40

# fixed values: the reference's tail cut-offs for the loss replacement
# (p <= 2 -> 35, p <= 3 -> 12, p <= 4 -> 7, otherwise 5)


def cutoff(p: float) -> float:
    """E5: z above which the reference switches to the polynomial tail."""
    if p <= 2:
        return 35.0
    if p <= 3:
        return 12.0
    if p <= 4:
        return 7.0
    return 5.0


def _check_p(p: float) -> float:
    p = float(p)
    if not p >= 1.0:
        raise ValueError("p must be >= 1")
    return p


def ln_q(a: float, s, ops=NP):
    """ln Q(a, s), the log of the regularised upper incomplete gamma function."""
    if a == 1.0:
        return -s
    lg_a = math.lgamma(a)
    lg_a1 = math.lgamma(a + 1.0)
    # series of P(a, s) for s < a + 1 (nested Horner form)
    acc = 1.0
    for n in range(SERIES_TERMS, 0, -1):
        acc = 1.0 + (s / (a + n)) * acc
    p_lower = ops.pow(s, a) * ops.exp(-s - lg_a1) * acc
    series = ops.log1p(-p_lower)
    # continued fraction of Q(a, s) for s >= a + 1, evaluated bottom-up
    t = s + (2 * CF_DEPTH + 1 - a)
    for n in range(CF_DEPTH, 0, -1):
        t = (s + (2 * (n - 1) + 1 - a)) + (-n * (n - a)) / t
    cf = -s + a * ops.ln(s) - lg_a - ops.ln(t)
    return ops.where(s < a + 1.0, series, cf)


def _s_of(z, p, ops):
    if p == 1.0:
        return ops.abs(z)
    if p == 2.0:
        return (z * z) / 2.0
    return ops.pow(ops.abs(z), p) / p


def ln_cdf_neg(z, p: float, ops=NP, s=None):
    """ln Phi_p(-z)."""
    p = _check_p(p)
    a = 1.0 / p
    s = _s_of(z, p, ops) if s is None else s
    lq = ln_q(a, s, ops)
    return ops.where(z >= 0, lq - math.log(2.0), ops.log1p(-0.5 * ops.exp(lq)))


def ln_pdf_const(p: float) -> float:
    return (1.0 - 1.0 / p) * math.log(p) - math.log(2.0) - math.lgamma(1.0 / p)


def pdf(x, p: float, ops=NP):
    """Density of the p-generalised normal."""
    p = _check_p(p)
    return ops.exp(ln_pdf_const(p) - _s_of(x, p, ops))


def cdf(x, p: float, ops=NP):
    """Phi_p(x) = exp(ln Phi_p(-(-x)))."""
    return ops.exp(ln_cdf_neg(-x, p, ops))


@lru_cache(maxsize=64)
def _tail_consts(p: float):
    c = cutoff(p)
    z = np.array([c])
    g_c = float(-ln_cdf_neg(z, p)[0])
    gp_c = float(np.exp(ln_pdf_const(p) - c ** p / p - ln_cdf_neg(z, p)[0]))
    return c, g_c - c ** p / p, gp_c - c ** (p - 1)


def loss(z, p: float, ops=NP, tail: str = "exact", s=None):
    """g(z) = -ln Phi_p(-z); tail='reference' uses the polynomial tail above the cut-off."""
    p = _check_p(p)
    out = -ln_cdf_neg(z, p, ops, s)
    if tail == "reference":
        c, diff, _ = _tail_consts(p)
        out = ops.where(z > c, diff + ops.pow(ops.abs(z), p) / p, out)
    return out


def loss_grad(z, p: float, ops=NP, tail: str = "exact", s=None, lcdf=None):
    """g'(z) = phi_p(z) / Phi_p(-z)."""
    p = _check_p(p)
    s = _s_of(z, p, ops) if s is None else s
    lcdf = ln_cdf_neg(z, p, ops, s) if lcdf is None else lcdf
    out = ops.exp(ln_pdf_const(p) - s - lcdf)
    if tail == "reference":
        c, _, gdiff = _tail_consts(p)
        out = ops.where(z > c, gdiff + ops.pow(ops.abs(z), p - 1.0), out)
    return out


def loss_hess(z, gp, p: float, ops=NP):
    """g''(z) from g'(z)."""
    if p == 1.0:
        return gp * (gp - ops.sign(z))
    if p == 2.0:
        return gp * (gp - z)
    return gp * (gp - ops.sign(z) * ops.pow(ops.abs(z), p - 1.0))


# -- numpy conveniences -------------------------------------------------------

def _np_ln_q(a: float, s: np.ndarray) -> np.ndarray:
    """``ln_q`` for numpy arrays: each element takes only its own branch."""
    if a == 1.0:
        return -s
    out = np.empty_like(s)
    low = s < a + 1.0
    for mask, branch in ((low, s[low]), (~low, s[~low])):
        if branch.size:
            with np.errstate(all="ignore"):
                out[mask] = ln_q(a, branch)
    return out


def np_ln_cdf_neg(z: np.ndarray, p: float) -> np.ndarray:
    lq = _np_ln_q(1.0 / p, _s_of(z, p, NP))
    with np.errstate(all="ignore"):
        return np.where(z >= 0, lq - math.log(2.0), np.log1p(-0.5 * np.exp(lq)))


def np_loss(z: np.ndarray, p: float, tail: str = "exact") -> np.ndarray:
    """g(z) alone (no gradient or curvature), for evaluations of many parameters."""
    p = _check_p(p)
    z = np.asarray(z, dtype=float)
    g = -np_ln_cdf_neg(z, p)
    if tail == "reference":
        c, diff, _ = _tail_consts(p)
        g = np.where(z > c, diff + np.abs(z) ** p / p, g)
    return g


def np_loss_grad_hess(z: np.ndarray, p: float, tail: str = "exact", want_hess: bool = True):
    """(g, g', g'') on a numpy array; no g'' without ``want_hess``."""
    z = np.asarray(z, dtype=float)
    with np.errstate(all="ignore"):
        s = _s_of(z, p, NP)
        lc = np_ln_cdf_neg(z, _check_p(p))
        g = -lc
        gp = np.exp(ln_pdf_const(p) - s - lc)
        if tail == "reference":
            c, diff, gdiff = _tail_consts(p)
            g = np.where(z > c, diff + np.abs(z) ** p / p, g)
            gp = np.where(z > c, gdiff + np.abs(z) ** (p - 1.0), gp)
        h = loss_hess(z, gp, p, NP) if want_hess else None
    return g, gp, h


def sql_loss_terms(z_col: str, p: float, dialect: str = "spark", tail: str = "exact"):
    """SQL text for (g(z), g'(z), g''(z)) given a column name holding z.

    The three texts share sub-expressions; callers materialise ``s`` and ``lcdf``
    as columns first (see ``loss_columns``) to keep the generated code small.
    """
    ops = SqlOps(dialect)
    z = ops.col(z_col)
    return loss(z, p, ops, tail), loss_grad(z, p, ops, tail)


def sql_s(z_col: str, p: float, dialect: str = "spark") -> str:
    ops = SqlOps(dialect)
    return _s_of(ops.col(z_col), float(p), ops).sql


def sql_ln_cdf_neg(z_col: str, s_col: str, p: float, dialect: str = "spark") -> str:
    ops = SqlOps(dialect)
    return ln_cdf_neg(ops.col(z_col), float(p), ops, ops.col(s_col)).sql


def sql_from_lcdf(z_col: str, s_col: str, lcdf_col: str, p: float, dialect: str = "spark",
                  tail: str = "exact"):
    """SQL for g, g', g'' from precomputed s and ln Phi_p(-z) columns."""
    ops = SqlOps(dialect)
    p = float(p)
    z, s, lc = ops.col(z_col), ops.col(s_col), ops.col(lcdf_col)
    g = -lc
    gp = ops.exp(ln_pdf_const(p) - s - lc)
    if tail == "reference":
        c, diff, gdiff = _tail_consts(p)
        g = ops.where(z > c, diff + ops.pow(ops.abs(z), p) / p, g)
        gp = ops.where(z > c, gdiff + ops.pow(ops.abs(z), p - 1.0), gp)
    return g.sql, gp.sql


def sql_hess(z_col: str, gp_col: str, p: float, dialect: str = "spark") -> str:
    ops = SqlOps(dialect)
    return loss_hess(ops.col(z_col), ops.col(gp_col), float(p), ops).sql


# -- scalar path (per-row loops such as SGD) -----------------------------------

def _ln_q_scalar(a: float, s: float, lg_a: float, lg_a1: float) -> float:
    if a == 1.0:
        return -s
    if s < a + 1.0:
        acc = 1.0
        for n in range(SERIES_TERMS, 0, -1):
            acc = 1.0 + (s / (a + n)) * acc
        return math.log1p(-(s ** a) * math.exp(-s - lg_a1) * acc)
    t = s + (2 * CF_DEPTH + 1 - a)
    for n in range(CF_DEPTH, 0, -1):
        t = (s + (2 * (n - 1) + 1 - a)) + (-n * (n - a)) / t
    return -s + a * math.log(s) - lg_a - math.log(t)


def scalar_grad(p: float):
    """A fast float -> float g'(z) for one p (same formulas as the vectorised kernel)."""
    p = _check_p(p)
    a = 1.0 / p
    lg_a, lg_a1, lc = math.lgamma(a), math.lgamma(a + 1.0), ln_pdf_const(p)

    def gp(z: float) -> float:
        az = abs(z)
        s = az if p == 1.0 else (z * z / 2.0 if p == 2.0 else az ** p / p)
        lq = _ln_q_scalar(a, s, lg_a, lg_a1)
        lcdf = lq - math.log(2.0) if z >= 0 else math.log1p(-0.5 * math.exp(lq))
        return math.exp(lc - s - lcdf)

    return gp
