"""Design tables.

A *design* turns any labelled table into the canonical layout

    id, [ord], y INT (+1/-1), w DOUBLE, x ARRAY<DOUBLE>

with optional standardisation (population sd, zero sd left unscaled), an optional
intercept appended as the last column, and optional dropping of constant and
single-non-zero columns. All statistics come from ONE aggregate pass; only
O(d) numbers reach the driver and are applied back as literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class DesignSpec:
    """How to read a design from a table.

    features: ordered {name: Column-or-column-name}; label: Column giving a truthy
    condition for +1 (``label_is_condition``) or a column already holding +-1.
    """

    id: str | Sequence[str]
    features: dict
    label: Column | str
    label_is_condition: bool = True
    order: str | None = None
    weight: Column | str | None = None
    standardize: bool | Sequence[str] = True
    intercept: bool = True
    drop_constant: bool = False
    drop_single_nonzero: bool = False
    drop: Sequence[str] = ()
    extra: Sequence[str] = ()


@dataclass
class Design:
    df: DataFrame
    features: list
    n: int
    n_pos: int
    n_neg: int
    means: dict = field(default_factory=dict)
    sds: dict = field(default_factory=dict)
    intercept: bool = True
    has_order: bool = False

    @property
    def d(self) -> int:
        return len(self.features) + (1 if self.intercept else 0)

    @property
    def names(self) -> list:
        return list(self.features) + (["intercept"] if self.intercept else [])

    def cache(self, min_partitions: int | None = None) -> "Design":
        """Persist the design (every score / fit pass re-reads it).

        A small input read as fewer splits than the cluster has cores is spread
        over all cores once before caching; large inputs keep their scan splits.
        """
        df = self.df
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < target:
            df = df.repartition(target)
        self.df = df.persist()
        return self

    def wide(self, decimals: int | None = None) -> DataFrame:
        """x as columns x_0..x_{d-1} (for inspection and SQL comparison)."""
        cols = []
        for j in range(self.d):
            c = F.col("x")[j]
            cols.append((rounded(c, decimals) if decimals is not None else c).alias(f"x_{j}"))
        keep = [c for c in self.df.columns if c != "x"]
        return self.df.select(*keep, *cols)


def rounded(c: Column, decimals: int) -> Column:
    """``F.round`` of a double, which takes each value through a decimal: only values near a tie, or too
    large for the integer steps of a double, need that. The others' nearest step, divided, is the same double."""
    unit = float(10 ** decimals)
    step = F.rint(c * unit)
    return F.when((F.abs(c * unit - step) < 0.499) & (F.abs(step) < 1e12), step / unit + 0.0).otherwise(F.round(c, decimals))


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def id_column(id_spec) -> Column:
    if isinstance(id_spec, str):
        return F.col(id_spec)
    cols = [F.col(c).cast("string") for c in id_spec]
    return F.concat_ws(":", *cols)


def label_pm1(cond: Column) -> Column:
    """B1/B2: one-vs-rest label, condition -> +1 else -1."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(-1)).cast("int")


def label_from01(col: Column) -> Column:
    """{0,1} -> {-1,+1} by 2y-1."""
    return (F.lit(2) * col - F.lit(1)).cast("int")


def add_intercept(x: Column) -> Column:
    """A2: append the constant 1 as the last column."""
    return F.concat(x, F.array(F.lit(1.0)))


def build_design(df: DataFrame, spec: DesignSpec, validate: bool = True) -> Design:
    """A1 + B4-B9 in one statistics pass."""
    base_cols = {name: _as_col(c).cast("double") for name, c in spec.features.items()
                 if name not in set(spec.drop)}
    label = label_pm1(_as_col(spec.label)) if spec.label_is_condition else _as_col(spec.label).cast("int")
    sel = [id_column(spec.id).alias("id")]
    if spec.order:
        sel.append(F.col(spec.order).alias("ord"))
    sel.append(label.alias("y"))
    sel.append((_as_col(spec.weight).cast("double") if spec.weight is not None else F.lit(1.0)).alias("w"))
    sel += [c.alias(f"_f{i}") for i, c in enumerate(base_cols.values())]
    sel += [F.col(c) for c in spec.extra]
    tmp = df.select(*sel)
    names = list(base_cols)

    std_set = set(names) if spec.standardize is True else set(spec.standardize or ())
    aggs = [F.count(F.lit(1)).alias("n"),
            F.sum((F.col("y") == 1).cast("long")).alias("n_pos"),
            F.sum((F.col("y") == -1).cast("long")).alias("n_neg")]
    for i, nm in enumerate(names):
        c = F.col(f"_f{i}")
        # only what is asked for: a wide table has six statistics a column otherwise
        aggs.append(F.count(c).alias(f"known{i}"))
        if nm in std_set:
            aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
        if spec.drop_constant:
            aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        if spec.drop_single_nonzero:
            aggs.append(F.sum((c != 0).cast("long")).alias(f"nz{i}"))
    st = tmp.agg(*aggs).collect()[0].asDict()
    n, n_pos, n_neg = int(st["n"]), int(st["n_pos"] or 0), int(st["n_neg"] or 0)
    if validate:
        if n == 0:
            raise ValueError("empty design")
        if n_pos + n_neg != n:
            raise ValueError("labels must be exactly -1 or +1")
        for i, nm in enumerate(names):
            if st[f"known{i}"] < n:
                raise ValueError(f"feature {nm} has nulls")

    kept, means, sds = [], {}, {}
    exprs = []
    for i, nm in enumerate(names):
        lo, hi = st.get(f"lo{i}"), st.get(f"hi{i}")
        if spec.drop_constant and not (lo is not None and hi is not None and lo < hi):
            continue
        if spec.drop_single_nonzero and st[f"nz{i}"] == 1:
            continue
        c = F.col(f"_f{i}")
        if nm in std_set:
            mu, sd = float(st[f"m{i}"]), float(st[f"s{i}"] or 0.0)
            sd_eff = sd if sd > 0 else 1.0
            means[nm], sds[nm] = mu, sd_eff
            c = (c - F.lit(mu)) / F.lit(sd_eff)
        kept.append(nm)
        exprs.append(c)
    if spec.intercept:
        exprs.append(F.lit(1.0))
    head = ["id"] + (["ord"] if spec.order else []) + ["y", "w"]
    out = tmp.select(*head, F.array(*exprs).alias("x"), *[F.col(c) for c in spec.extra])
    return Design(out, kept, n, n_pos, n_neg, means, sds, spec.intercept, bool(spec.order))


def from_arrays(spark, X, y, w=None, ids=None, order: bool = True) -> DataFrame:
    """Small in-memory design (tests and fixtures)."""
    import numpy as np

    X = np.asarray(X, dtype=float)
    if X.ndim != 2:
        raise ValueError("expected a matrix: rows by columns")
    y = np.asarray(y)
    if X.shape[0] != y.shape[0]:
        raise ValueError(f"{X.shape[0]} rows but {y.shape[0]} labels")
    w = np.ones(len(y)) if w is None else np.asarray(w, dtype=float)
    ids = list(range(len(y))) if ids is None else list(ids)
    rows = [(int(ids[i]), int(i), int(y[i]), float(w[i]), [float(v) for v in X[i]]) for i in range(len(y))]
    schema = "id BIGINT, ord BIGINT, y INT, w DOUBLE, x ARRAY<DOUBLE>"
    df = spark.createDataFrame(rows, schema)
    return df if order else df.drop("ord")


def validate_design(df: DataFrame, d: int | None = None, require_both: bool = True) -> dict:
    """One aggregate for row count, width and label set."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("dmin"),
               F.max(F.size("x")).alias("dmax"),
               F.sum((F.col("y") == 1).cast("long")).alias("pos"),
               F.sum((F.col("y") == -1).cast("long")).alias("neg")).collect()[0]
    if r["dmin"] != r["dmax"]:
        raise ValueError("rows of x have different lengths")
    if d is not None and r["dmin"] != d:
        raise ValueError(f"{d} coefficients for rows of {r['dmin']} columns")
    if (r["pos"] or 0) + (r["neg"] or 0) != r["n"]:
        raise ValueError("labels other than 1 and -1 found")
    if require_both and (not r["pos"] or not r["neg"]):
        raise ValueError("both labels, 1 and -1, have to occur")
    return {"n": r["n"], "d": r["dmin"], "n_pos": r["pos"], "n_neg": r["neg"]}
