"""Grouped summaries of sweep and posterior tables.

All quantiles are exact (linear interpolation between order statistics, the numpy /
pandas default). Spark's ``percentile`` holds a group's values in one task, so it is
used only when the largest group is bounded (sweep tables have ``runs`` rows per
size); above that ``select_quantiles`` finds the same order statistics by counting
values in ever narrower buckets. Nulls are ignored everywhere (pandas ``median``
semantics).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT_GROUP_LIMIT = 200_000
BUCKETS = 4096
MAX_BRACKET_GROUPS = 100_000
LOCAL_BRACKETS = 10_000     # order statistics whose brackets may pass through the driver


def _exact_ok(df: DataFrame, group_cols) -> bool:
    mx = df.groupBy(*group_cols).count().agg(F.max("count")).collect()[0][0]
    return mx is None or mx <= EXACT_GROUP_LIMIT


def _same(left: DataFrame, right: DataFrame, cols, how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; the key columns of ``left`` stay."""
    r = right.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(cols)], *[c for c in right.columns if c not in cols])
    on = [left[c].eqNullSafe(r[f"_r{i}"]) for i, c in enumerate(cols)]
    return left.join(r, on, how).drop(*[f"_r{i}" for i in range(len(cols))])


def select_quantiles(df: DataFrame, group_cols, specs) -> DataFrame:
    """Exact quantiles ``specs`` = [(alias, column name or Column, q)] per group, without holding a group in one task.

    Each order statistic sought is a rank in a bracket [lo, hi] of values. A pass counts the rows inside the brackets by
    bucket (count, least and largest value): first by sign and power of two, then in ``BUCKETS`` equal parts of each
    bracket. The bucket that holds the rank is the next bracket, until it holds one value. So a task holds counts of
    buckets only, never values or sketches, and five or six passes do for any doubles. Brackets are broadcast while they
    come from at most MAX_BRACKET_GROUPS groups.
    """
    spark, g = df.sparkSession, list(group_cols)
    of = [c if isinstance(c, str) else f"#{i}" for i, (_, c, _) in enumerate(specs)]  # a named column is read once
    values = {m: F.col(c) if isinstance(c, str) else c for m, (_, c, _) in zip(of, specs)}
    names = list(values)
    # + 0.0: one zero
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), (c.cast("double") + F.lit(0.0)).alias("_v")) for i, c in enumerate(values.values())]))
    base = df.select(*g, cells.alias("_e")).select(*g, "_e._c", "_e._v").filter(F.col("_v").isNotNull())
    at = [*g, "_c"]
    counted = [F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx")]
    v = F.col("_v")
    few = df.select(*g).distinct().count()
    local, held = 2 * few * len(specs) <= LOCAL_BRACKETS, []

    def kept(t):
        if local:  # a plan without earlier passes
            return spark.createDataFrame(t.collect(), t.schema).coalesce(1)
        held.append(t.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    power = F.floor(F.least(F.log2(F.abs(v)), F.lit(2000.0))) + 2000  # an infinity has no log to round
    key = F.when(F.isnan(v), 5000).when(v == 0, 0).when(v > 0, power).otherwise(-power).cast("int")
    running = Window.partitionBy(*at).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = base.groupBy(*at, key.alias("_b")).agg(*counted).withColumns(
        {"_end": F.sum("_k").over(running), "_n": F.sum("_k").over(Window.partitionBy(*at))})
    wanted = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(names.index(m)).alias("c"), F.lit(float(min(max(q, 0.0), 1.0))).alias("q"))
                       for i, (m, (_, _, q)) in enumerate(zip(of, specs))])
    pos = F.col("_t.q") * (F.col("_n") - 1)
    ends = F.explode(F.array(*[F.struct(F.lit(up).alias("up"), r.alias("r")) for up, r in ((0, F.floor(pos)), (1, F.ceil(pos)))]))
    j = (ranges.withColumn("_t", F.explode(wanted)).filter(F.col("_t.c") == F.col("_c"))
         .withColumns({"_frac": pos - F.floor(pos), "_o": ends})
         .select(*at, F.col("_t.s").alias("_s"), "_frac", F.col("_o.up").alias("_up"), F.col("_o.r").alias("_r"),
                 (F.col("_end") - F.col("_k")).alias("_from"), "_end", "_mn", "_mx"))
    found, single = None, F.col("_lo") == F.col("_hi")
    while True:
        state = kept(j.filter((F.col("_from") <= F.col("_r")) & (F.col("_r") < F.col("_end")))
                     .select(*at, "_s", "_frac", "_up", "_r", F.col("_mn").alias("_lo"), F.col("_mx").alias("_hi"), F.col("_from").alias("_below")))
        done = state.filter(single).select(*g, "_s", "_frac", "_up", "_lo")
        found = done if found is None else found.unionByName(done)
        todo = state.filter(~single)
        if todo.isEmpty():
            break
        brackets = todo.select(*at, "_lo", "_hi", "_below").distinct()
        inside = _same(base, F.broadcast(brackets) if few <= MAX_BRACKET_GROUPS else brackets, at).filter((v >= F.col("_lo")) & (v <= F.col("_hi")))
        part = F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(BUCKETS)))
        running = Window.partitionBy(*at, "_lo").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranges = (inside.groupBy(*at, "_lo", "_below", F.least(part, F.lit(BUCKETS - 1)).cast("int").alias("_b")).agg(*counted)
                  .withColumn("_end", F.col("_below") + F.sum("_k").over(running))
                  .select(*at, "_lo", (F.col("_end") - F.col("_k")).alias("_from"), "_end", "_mn", "_mx"))
        j = _same(todo.drop("_hi", "_below"), ranges, [*at, "_lo"])
    ends = found.groupBy(*g, "_s").agg(F.max(F.when(F.col("_up") == 0, F.col("_lo"))).alias("_a"), F.max(F.when(F.col("_up") == 1, F.col("_lo"))).alias("_z"), F.max("_frac").alias("_frac"))
    value = F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise(F.col("_a") + F.col("_frac") * (F.col("_z") - F.col("_a")))
    out = kept(ends.groupBy(*g).agg(*[F.max(F.when(F.col("_s") == i, value)).alias(a) for i, (a, _, _) in enumerate(specs)]))
    if not local:
        out.count()  # one row a group is kept, the brackets are let go
        for t in held[:-1]:
            t.unpersist()
    return out


def select_quantile(df: DataFrame, group_cols, value, q: float, out: str = "_q") -> DataFrame:
    """Exact q-quantile of ``value`` per group (``select_quantiles``)."""
    return select_quantiles(df, group_cols, [(out, value, q)])


def quantile_stats(df: DataFrame, group_cols, specs, extra=()) -> DataFrame:
    """Per group: exact quantiles ``specs`` = [(alias, column name or Column, q)] plus
    ``extra`` aggregate Columns. One aggregate when the largest group is bounded,
    else ``select_quantiles`` joined on the group keys."""
    g = list(group_cols)
    if _exact_ok(df, g):
        cols = [F.percentile(F.col(c) if isinstance(c, str) else c, q).alias(a) for a, c, q in specs]
        return df.groupBy(*g).agg(*cols, *extra)
    out = df.groupBy(*g).agg(*extra) if extra else df.select(*g).distinct()
    out = _same(out, select_quantiles(df, g, specs), g, "left")
    return out.select(*g, *[a for a, _, _ in specs], *[c for c in out.columns if c not in g and c not in {a for a, _, _ in specs}])


def sweep_summary(df: DataFrame, group_cols=("size",), value: str = "ratio",
                  time_col: str | None = "total_time_s", method: str | None = None) -> DataFrame:
    """G1: per group median, sd (ddof 1), MAD (unscaled), q75, q25 of ``value``,
    median of ``time_col``; optional method tag (B17)."""
    g = list(group_cols)
    if not g:
        df, g = df.withColumn("_all", F.lit(0)), ["_all"]
    med = quantile_stats(df, g, [("_med", value, 0.5)])
    # one row per group: AQE broadcasts it when it is small, shuffles it otherwise
    with_med = df.join(med, g)
    mad = quantile_stats(with_med, g, [("mad", F.abs(F.col(value) - F.col("_med")), 0.5)])
    specs = [(f"median_{value}", value, 0.5), ("q75", value, 0.75), ("q25", value, 0.25)]
    if time_col:
        specs.append((f"median_{time_col}", time_col, 0.5))
    out = quantile_stats(df, g, specs, [F.stddev_samp(value).alias("std")]).join(mad, g)
    if method is not None:
        out = out.withColumn("method", F.lit(method))
    return out


def metric_summary(df: DataFrame, group_cols=("size",), value: str = "mmd") -> DataFrame:
    """Per group median, q25, q75 and count of a posterior metric."""
    g = list(group_cols)
    return quantile_stats(df, g, [("median", value, 0.5), ("q25", value, 0.25), ("q75", value, 0.75)],
                          [F.count(value).alias("count")])


def medians(df: DataFrame, group_cols, value_cols) -> DataFrame:
    """Median of each value column per group."""
    return quantile_stats(df, list(group_cols), [(c, c, 0.5) for c in value_cols])


def robust_band(q: Column, median: Column, factor: float = 0.7413) -> Column:
    """(q - median) * 0.7413 + median."""
    return (q - median) * F.lit(factor) + median


def five_number(df: DataFrame, group_cols, value: str) -> DataFrame:
    """Min, q25, median, q75, max per group (box summary)."""
    g = list(group_cols)
    t = quantile_stats(df, g, [("q25", value, 0.25), ("median", value, 0.5), ("q75", value, 0.75)],
                       [F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max")])
    return t.select(*g, "min", "q25", "median", "q75", "max")


def run_inventory(df: DataFrame, group_cols=("p", "dataset", "method"), run: str = "run") -> DataFrame:
    """Largest run number per group."""
    return df.groupBy(*group_cols).agg(F.max(run).alias("max_run"))


def draws_per_second(df: DataFrame, burn_in: int, draws: int, run: str = "run") -> DataFrame:
    """(burn_in + draws) / median(total - reduction) per run, then the median over runs."""
    per_run = df.groupBy(run).agg(F.percentile(F.col("total_time_s") - F.col("reduction_time_s"), 0.5)
                                  .alias("_t"))
    per_run = per_run.withColumn("draws_per_s", F.lit(float(burn_in + draws)) / F.col("_t"))
    one = quantile_stats(per_run.withColumn("_all", F.lit(0)), ["_all"], [("median_draws_per_s", "draws_per_s", 0.5)])
    return one.select("median_draws_per_s")


def smallest_size_in_band(df: DataFrame, lo: float = 0.05, hi: float = 0.1, group: str = "p",
                          size: str = "k", eps: str = "eps") -> DataFrame:
    """Smallest k per p with eps in [lo, hi], and k / (p ln p)."""
    t = df.filter((F.col(eps) >= lo) & (F.col(eps) <= hi)).groupBy(group).agg(F.min(size).alias("min_k"))
    return t.withColumn("k_scaled", F.when(F.col(group) > 1, F.col("min_k") / (F.col(group) * F.log(group))))


def distinct_values(df: DataFrame, col: str = "size") -> DataFrame:
    """G9."""
    return df.select(col).distinct()


def union_all(frames) -> DataFrame:
    """Concat of result tables by column name."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def sort_by(df: DataFrame, col: str, ascending: bool = True) -> DataFrame:
    """G11."""
    return df.orderBy(F.col(col).asc() if ascending else F.col(col).desc())
