"""Tiny SQL-text expression values.

Numeric kernels (the p-generalised normal tail, hash uniforms) are written once
against a small set of operations and evaluated either on numpy arrays (inside
Arrow-batched tasks) or rendered to SQL text. The SQL text is handed to
``F.expr`` so the kernel runs JVM-side inside whole-stage codegen; the same text,
rendered for DuckDB, is what the test oracle runs.
"""

from __future__ import annotations

import math

import numpy as np


def _fmt(v) -> str:
    if isinstance(v, Sx):
        return v.sql
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    v = float(v)
    if math.isinf(v):
        return "(1e308 * 10)" if v > 0 else "(-1e308 * 10)"
    return repr(v) if "e" not in repr(v) else f"{v:.17e}"


class Sx:
    """A SQL expression string with arithmetic operators."""

    __slots__ = ("sql", "dialect")

    def __init__(self, sql: str, dialect: str = "spark"):
        self.sql = sql
        self.dialect = dialect

    def _b(self, op, other, rev=False):
        a, b = (_fmt(other), self.sql) if rev else (self.sql, _fmt(other))
        return Sx(f"({a} {op} {b})", self.dialect)

    __add__ = lambda s, o: s._b("+", o)
    __radd__ = lambda s, o: s._b("+", o, True)
    __sub__ = lambda s, o: s._b("-", o)
    __rsub__ = lambda s, o: s._b("-", o, True)
    __mul__ = lambda s, o: s._b("*", o)
    __rmul__ = lambda s, o: s._b("*", o, True)
    __truediv__ = lambda s, o: s._b("/", o)
    __rtruediv__ = lambda s, o: s._b("/", o, True)
    __lt__ = lambda s, o: s._b("<", o)
    __le__ = lambda s, o: s._b("<=", o)
    __gt__ = lambda s, o: s._b(">", o)
    __ge__ = lambda s, o: s._b(">=", o)

    def __neg__(self):
        return Sx(f"(-{self.sql})", self.dialect)

    def __str__(self):
        return self.sql


class SqlOps:
    """Operations rendering SQL text for ``dialect`` in {'spark', 'duckdb'}."""

    def __init__(self, dialect: str = "spark"):
        self.dialect = dialect

    def col(self, name: str) -> Sx:
        return Sx(name, self.dialect)

    def _f(self, name, *args):
        return Sx(f"{name}({', '.join(_fmt(a) for a in args)})", self.dialect)

    def exp(self, x):
        return self._f("exp", x)

    def ln(self, x):
        return self._f("ln", x)

    def log1p(self, x):
        if self.dialect == "spark":
            return self._f("log1p", x)
        return self._f("ln", Sx(f"(1 + {_fmt(x)})", self.dialect))

    def pow(self, x, y):
        return self._f("power", x, y)

    def expm1(self, x):
        if self.dialect == "spark":
            return self._f("expm1", x)
        return Sx(f"(exp({_fmt(x)}) - 1)", self.dialect)

    def least(self, a, b):
        return self._f("least", a, b)

    def abs(self, x):
        return self._f("abs", x)

    def sign(self, x):
        return self._f("sign", x)

    def sqrt(self, x):
        return self._f("sqrt", x)

    def where(self, cond, a, b):
        return Sx(f"(CASE WHEN {_fmt(cond)} THEN {_fmt(a)} ELSE {_fmt(b)} END)", self.dialect)


class NpOps:
    """The same operations on numpy arrays."""

    @staticmethod
    def exp(x):
        return np.exp(x)

    @staticmethod
    def ln(x):
        return np.log(x)

    @staticmethod
    def log1p(x):
        return np.log1p(x)

    @staticmethod
    def pow(x, y):
        return np.power(x, y)

    @staticmethod
    def expm1(x):
        return np.expm1(x)

    @staticmethod
    def least(a, b):
        return np.minimum(a, b)

    @staticmethod
    def abs(x):
        return np.abs(x)

    @staticmethod
    def sign(x):
        return np.sign(x)

    @staticmethod
    def sqrt(x):
        return np.sqrt(x)

    @staticmethod
    def where(cond, a, b):
        return np.where(cond, a, b)


NP = NpOps()
