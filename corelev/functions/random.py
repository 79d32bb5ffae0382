"""Reproducible per-row randomness.

Every random number is a pure function of (row id, stream, seed):

    u = (int(hex13(md5(id ':' stream ':' seed))) + 0.5) / 2^52   in (0, 1)

so results do not depend on partitioning, retries or executor loss, and the
same value can be computed by any SQL engine with ``md5``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = 4503599627370496.0


def _key(id_col, stream, seed) -> Column:
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    st = stream if isinstance(stream, Column) else F.lit(str(stream))
    return F.concat_ws(":", idc.cast("string"), st.cast("string"), F.lit(str(int(seed))))


def uniform(id_col, seed: int = 0, stream="u") -> Column:
    """Uniform (0,1) double derived from md5 of the row id."""
    h = F.conv(F.substring(F.md5(_key(id_col, stream, seed)), 1, 13), 16, 10)
    return (h.cast("double") + F.lit(0.5)) / F.lit(TWO52)


def uniform_sql(id_sql: str, seed: int = 0, stream: str = "u", dialect: str = "duckdb",
                stream_sql: str | None = None) -> str:
    """The same uniform as SQL text (used by oracles)."""
    st = stream_sql if stream_sql is not None else f"'{stream}'"
    cast = "VARCHAR" if dialect == "duckdb" else "STRING"
    key = f"concat_ws(':', CAST({id_sql} AS {cast}), CAST({st} AS {cast}), '{int(seed)}')"
    if dialect == "duckdb":
        h = f"CAST(CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) AS DOUBLE)"
    else:
        h = f"CAST(conv(substr(md5({key}), 1, 13), 16, 10) AS DOUBLE)"
    return f"(({h} + 0.5) / {TWO52})"


def bucket(id_col, buckets: int, seed: int = 0, stream="bucket") -> Column:
    """Hash bucket in [0, buckets) (CountSketch row map)."""
    return F.floor(uniform(id_col, seed, stream) * F.lit(float(buckets))).cast("long")


def sign(id_col, seed: int = 0, stream="sign") -> Column:
    """Random sign +-1 (CountSketch sign map)."""
    return F.when(uniform(id_col, seed, stream) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))


def exponential(id_col, seed: int = 0, stream="exp") -> Column:
    """Exp(1) draw -ln(u)."""
    return -F.log(uniform(id_col, seed, stream))


def normal(id_col, seed: int = 0, stream="n") -> Column:
    """Standard normal by Box-Muller over two hash uniforms."""
    st = stream if isinstance(stream, Column) else F.lit(str(stream))
    u1 = uniform(id_col, seed, F.concat(st, F.lit("#1")))
    u2 = uniform(id_col, seed, F.concat(st, F.lit("#2")))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


# -- counters: many uniforms from one hash ---------------------------------------
#
# base = int(hex15(md5(id ':' stream ':' seed))); the t-th uniform of a base is the 64-bit finaliser of
# splitmix64 over base + t * GOLDEN, its upper 53 bits scaled into (0, 1).

# fixed values: splitmix64's increment and multipliers
GOLDEN = 0x9E3779B97F4A7C15
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


def counter_base(id_text: str, stream: str, seed: int) -> int:
    import hashlib

    return int(hashlib.md5(f"{id_text}:{stream}:{int(seed)}".encode()).hexdigest()[:15], 16)


def np_counter_uniform(base, step: int):
    """The ``step``-th uniform of every base (numpy)."""
    import numpy as np

    with np.errstate(over="ignore"):
        z = np.asarray(base, dtype=np.uint64) + np.uint64(step) * np.uint64(GOLDEN)
        for shift, factor in MIX:
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53


def counter_base_sql(id_sql: str, stream_sql: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', CAST({id_sql} AS VARCHAR), {stream_sql}, '{int(seed)}')), 1, 15) AS UBIGINT)"


def counter_uniform_sql(base_sql: str, step_sql: str) -> str:
    """The same uniform as DuckDB SQL: 64-bit products by way of 128 bits."""
    wrap = f"{1 << 64}::UHUGEINT"
    z = f"[(CAST({base_sql} AS UHUGEINT) + CAST({step_sql} AS UHUGEINT) * {GOLDEN}::UHUGEINT) % {wrap}]"
    for shift, factor in MIX:
        z = f"list_transform({z}, lambda z: (xor(z, z // {1 << shift}::UHUGEINT) * {factor}::UHUGEINT) % {wrap})"
    return f"list_transform({z}, lambda z: (CAST(xor(z, z // {1 << 31}::UHUGEINT) // 2048::UHUGEINT AS DOUBLE) + 0.5) / 9007199254740992.0)[1]"
