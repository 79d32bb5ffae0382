"""Weighted moments X^T W X, X^T W z.

Small d: one native aggregate of d(d+1)/2 ``sum`` expressions (whole-stage codegen,
map-side partial aggregation, no Python). Large d: ``mapInArrow`` computes one
partial d x d matrix per partition with numpy; the partials are summed on the
executors by position (``posexplode`` + ``groupBy(pos)``), so the driver only
ever receives d(d+1)/2 numbers regardless of the partition count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NATIVE_MAX_D = 12


def _w(weight) -> Column:
    if weight is None:
        return F.lit(1.0)
    return F.col(weight) if isinstance(weight, str) else weight


def array_width(df: DataFrame, col: str = "x") -> int:
    r = df.select(F.size(col).alias("d")).limit(1).collect()
    if not r:
        raise ValueError("empty design")
    return int(r[0]["d"])


def _triu(d):
    return [(i, j) for i in range(d) for j in range(i, d)]


def _unpack(vals, d):
    G = np.zeros((d, d))
    for (i, j), v in zip(_triu(d), vals):
        G[i, j] = G[j, i] = 0.0 if v is None else v
    return G


def _batch_matrix(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    arr = batch.column(batch.schema.get_field_index(name))
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(-1, d) if len(flat) else np.zeros((0, d))


def gram(df: DataFrame, d: int | None = None, weight=None, col: str = "x",
         vector: Column | str | None = None, method: str = "auto"):
    """Return G = sum w x x^T (and b = sum w v x if ``vector`` is given)."""
    d = array_width(df, col) if d is None else d
    method = ("native" if d <= NATIVE_MAX_D else "arrow") if method == "auto" else method
    w = _w(weight)
    vcol = (F.col(vector) if isinstance(vector, str) else vector) if vector is not None else None
    if method == "native":
        x = F.col(col)
        aggs = [F.sum(w * x[i] * x[j]).alias(f"g{i}_{j}") for i, j in _triu(d)]
        if vcol is not None:
            aggs += [F.sum(w * vcol * x[i]).alias(f"b{i}") for i in range(d)]
        r = df.agg(*aggs).collect()[0]
        G = _unpack([r[f"g{i}_{j}"] for i, j in _triu(d)], d)
        if vcol is None:
            return G
        return G, np.array([r[f"b{i}"] or 0.0 for i in range(d)])
    return _gram_arrow(df, d, w, col, vcol)


def _gram_arrow(df, d, w, col, vcol):
    sel = df.select(F.col(col).alias("x"), w.cast("double").alias("w"),
                    (vcol if vcol is not None else F.lit(0.0)).cast("double").alias("v"))
    iu = np.triu_indices(d)
    has_v = vcol is not None

    def part(batches):
        G = np.zeros((d, d))
        b = np.zeros(d)
        seen = False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            seen = True
            X = _batch_matrix(batch, "x", d)
            wv = batch.column(1).to_numpy(zero_copy_only=False)
            G += X.T @ (X * wv[:, None])
            if has_v:
                b += X.T @ (wv * batch.column(2).to_numpy(zero_copy_only=False))
        if seen:
            vals = np.concatenate([G[iu], b])
            yield pa.RecordBatch.from_arrays([pa.array([vals.tolist()], type=pa.list_(pa.float64()))],
                                             names=["part"])

    parts = sel.mapInArrow(part, "part ARRAY<DOUBLE>")
    summed = (parts.select(F.posexplode("part").alias("pos", "val"))
              .groupBy("pos").agg(F.sum("val").alias("val")).collect())
    m = len(iu[0])
    vals = np.zeros(m + d)
    for r in summed:
        vals[r["pos"]] = r["val"]
    G = np.zeros((d, d))
    G[iu] = vals[:m]
    G = G + np.triu(G, 1).T
    if not has_v:
        return G
    return G, vals[m:]


def gram_table(df: DataFrame, d: int, weight=None, col: str = "x") -> DataFrame:
    """C1 as a DataFrame in long form (i, j, value), i <= j, computed without the driver."""
    w = _w(weight)
    if d <= NATIVE_MAX_D:
        x = F.col(col)
        aggs = [F.sum(w * x[i] * x[j]).alias(f"g{i}_{j}") for i, j in _triu(d)]
        wide = df.agg(*aggs)
        stack = ", ".join(f"{i}, {j}, g{i}_{j}" for i, j in _triu(d))
        return wide.selectExpr(f"stack({len(_triu(d))}, {stack}) AS (i, j, value)")
    iu = np.triu_indices(d)
    sel = df.select(F.col(col).alias("x"), w.cast("double").alias("w"))

    def part(batches):
        G = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                X = _batch_matrix(batch, "x", d)
                wv = batch.column(1).to_numpy(zero_copy_only=False)
                G += X.T @ (X * wv[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([G[iu].tolist()], type=pa.list_(pa.float64()))],
                                         names=["part"])

    pos_i = F.array(*[F.lit(int(v)) for v in iu[0]])
    pos_j = F.array(*[F.lit(int(v)) for v in iu[1]])
    return (sel.mapInArrow(part, "part ARRAY<DOUBLE>")
            .select(F.posexplode("part").alias("pos", "val"))
            .groupBy("pos").agg(F.sum("val").alias("value"))
            .select(pos_i[F.col("pos")].alias("i"), pos_j[F.col("pos")].alias("j"), "value"))
