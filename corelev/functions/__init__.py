"""Column-level functions: hash randomness, p-normal kernels, kernels, SQL text helpers."""

from . import exprs, pnormal, random  # noqa: F401
