"""Samplers (D1-D9).

Weighted sampling without replacement is the exponential race: key_i = E_i / p_i
with E_i = -ln u(id), the k smallest keys. This has the law of successive
sampling (``choice(replace=False, p=p)``), is one pass, and is mergeable.

Scale: ``orderBy(key).limit(k)`` alone would move k rows from EVERY partition into
one task. We first find a threshold tau with count(key <= tau) >= k from a
log-bucket histogram of the keys (one partial aggregate over a few thousand
buckets, which also yields sum(w), so weights never need a separate
normalisation pass), and only the ~1.02 k rows below tau reach the final top-k.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import random as R
from . import scores as S

HIST_BASE = 1.02
HIST_LIMIT = 40_000   # |log_1.02(key)| above this is clipped (covers every finite double)


def race_key(weight: Column, seed: int, stream) -> Column:
    """E / w with E = -ln u(id): ordering by it is the same for w and for w / sum(w)."""
    return R.exponential("id", seed, stream) / weight


def _histogram(df: DataFrame, key: Column, weight: Column, group: str | None = None):
    """ONE aggregate: per group, counts of keys by log-bucket, total weight and row count."""
    b = F.greatest(F.lit(-HIST_LIMIT), F.least(F.lit(HIST_LIMIT),
                                               F.ceil(F.log(key) / F.lit(math.log(HIST_BASE))))).cast("int")
    gcols = [group] if group else []
    rows = (df.select(*gcols, b.alias("b"), weight.alias("_w")).groupBy(*gcols, "b")
            .agg(F.count(F.lit(1)).alias("c"), F.sum("_w").alias("sw")).collect())
    per = {}
    for r in rows:
        g = r[group] if group else None
        per.setdefault(g, []).append((r["b"], r["c"], r["sw"]))
    return per


def _threshold_from(hist_rows, k: int):
    """(tau, total weight): smallest bucket edge with count(key <= tau) >= k (None = no filter)."""
    hist_rows = sorted(hist_rows)
    total = sum(c for _, c, _ in hist_rows)
    wsum = float(sum(sw for _, _, sw in hist_rows))
    _check_size(k, total)
    cum = 0
    for b, c, _ in hist_rows:
        cum += c
        if cum >= k:
            return (None if b >= HIST_LIMIT else HIST_BASE ** b), wsum
    return None, wsum


def _weight_totals(df: DataFrame, weight: str):
    """(rows with positive weight, sum of weights); a negative weight is an error."""
    w = F.col(weight).cast("double")
    t = df.agg(F.count(F.when(w > 0, 1)).alias("c"), F.sum(F.when(w > 0, w)).alias("sw"), F.min(w).alias("lo")).collect()[0]
    if t["lo"] is not None and t["lo"] < 0:
        raise ValueError(f"column {weight} holds a negative weight ({t['lo']})")
    return int(t["c"]), float(t["sw"] or 0.0)


def _check_size(k: int, n: int | None = None):
    if k <= 0:
        raise ValueError(f"a sample needs at least one row, not {k}")
    if n is not None and k > n:
        raise ValueError(f"{k} rows asked for, {n} can be drawn")


def weighted_sample(df: DataFrame, k: int, weight: str = "p", seed: int = 0, stream: str = "race",
                    key_out: str | None = None, prob_out: str = "p") -> DataFrame:
    """K rows without replacement with P(first pick = i) = w_i / sum(w) (successive sampling).

    Two passes over the rows: (1) one aggregate with the log-bucket histogram of
    the race keys and sum(w); (2) the rows under the threshold (about 1.02 k)
    go to the final top-k. ``prob_out`` = w / sum(w) is added to the sample.
    """
    _check_size(k)
    count, wsum = _weight_totals(df, weight)
    _check_size(k, count)
    pos = df.filter(F.col(weight) > 0)
    key = race_key(F.col(weight), seed, stream)
    cand = pos.withColumn("_key", key)
    if k <= TOPK_MAX:
        out = _small_k_candidates(pos, cand, k, weight, key, count, wsum)
        out = out.orderBy("_key", "id").limit(k)
    else:
        hist = _histogram(pos, key, F.col(weight))[None]
        tau, _ = _threshold_from(hist, k)
        if tau is not None:
            cand = cand.filter(F.col("_key") <= F.lit(tau))
        out = _smallest_keys(cand, k, hist)
    out = out.withColumn(prob_out, F.col(weight) / F.lit(wsum))
    return out.withColumnRenamed("_key", key_out) if key_out else out.drop("_key")


OVERSAMPLE = 3.0


def _small_k_candidates(pos: DataFrame, cand: DataFrame, k: int, weight: str, key: Column, count: int, wsum: float):
    """Candidates holding the k smallest keys, with ONE hashing pass.

    Since P(E / w_i <= t) = 1 - exp(-t w_i) <= t w_i, the rows with key <= 3 k / sum(w)
    number at most 3 k in expectation for any weights; when fewer than k pass (weight
    concentrated on fewer than k rows) the log-bucket histogram threshold is used instead.
    """
    from pyspark import StorageLevel

    if count <= OVERSAMPLE * k:
        return cand
    sel = cand.filter(F.col("_key") <= F.lit(OVERSAMPLE * k / wsum)).persist(StorageLevel.MEMORY_AND_DISK)
    if sel.count() >= k:
        return sel
    sel.unpersist()
    tau, _ = _threshold_from(_histogram(pos, key, F.col(weight))[None], k)
    return cand if tau is None else cand.filter(F.col("_key") <= F.lit(tau))


#: Rows allowed into the one final top-k task. The sample is the same either way; beyond it the
#: boundary is refined by aggregates first.
TOPK_MAX = 200_000
SUB_BUCKETS = 4096


def _bucket(key: Column) -> Column:
    """The log-bucket of ``_histogram`` (bucket b holds keys in (base^(b-1), base^b])."""
    return F.greatest(F.lit(-HIST_LIMIT), F.least(F.lit(HIST_LIMIT),
                                                  F.ceil(F.log(key) / F.lit(math.log(HIST_BASE))))).cast("int")


def _smallest_keys(cand: DataFrame, k: int, hist, max_rounds: int = 8) -> DataFrame:
    """The k rows of smallest (``_key``, id) for large k without one big top-k task.

    Rows in log-buckets below the boundary bucket are taken by a filter. The
    boundary bucket is split into linear sub-buckets by one more aggregate until
    it holds at most TOPK_MAX rows; only those go to a top-k for the remaining m.
    Same rows as ``orderBy(_key, id).limit(k)``.
    """
    key = F.col("_key")
    cum, bstar, nb = 0, None, 0
    for b, c, _ in sorted(hist):
        if cum + c >= k:
            bstar, nb = b, c
            break
        cum += c
    inside = _bucket(key) < F.lit(bstar)
    bnd = _bucket(key) == F.lit(bstar)
    lo, hi = HIST_BASE ** (bstar - 1), HIST_BASE ** bstar
    rounds = 0
    while nb > TOPK_MAX and rounds < max_rounds and abs(bstar) < HIST_LIMIT:
        rounds += 1
        width = (hi - lo) / SUB_BUCKETS
        sub = F.least(F.lit(SUB_BUCKETS - 1), F.greatest(F.lit(0), F.floor((key - F.lit(lo)) / F.lit(width)))).cast("int")
        rows = sorted((r["s"], r["c"]) for r in cand.filter(bnd).groupBy(sub.alias("s"))
                      .agg(F.count(F.lit(1)).alias("c")).collect())
        for j, c in rows:
            if cum + c >= k:
                inside = inside | (bnd & (sub < F.lit(j)))
                bnd = bnd & (sub == F.lit(j))
                lo, hi, nb = lo + j * width, lo + (j + 1) * width, c
                break
            cum += c
    m = k - cum
    return cand.filter(inside).unionByName(cand.filter(bnd).orderBy("_key", "id").limit(m))


def keyed_weighted_sample(df: DataFrame, k: int, weight: str, key: str, seed: int = 0,
                          stream: str = "race") -> DataFrame:
    """D2 per key: k rows without replacement per group, mergeable and skew-safe.

    ``row_number() <= k`` over (key order by race key) is planned with
    WindowGroupLimit on both sides of the shuffle, so even a key holding a third
    of all rows sends at most k rows per partition to its final task.
    """
    _check_size(k)
    pos = df.filter(F.col(weight) > 0).withColumn("_key", race_key(F.col(weight), seed, stream))
    w = Window.partitionBy(key).orderBy("_key", "id")
    return (pos.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
            .drop("_key", "_rank"))


def uniform_sample(df: DataFrame, k: int, seed: int = 0, n: int | None = None,
                   stream: str = "uniform") -> DataFrame:
    """Exactly k rows uniformly without replacement, weight 1."""
    n = int(df.count()) if n is None else n
    _check_size(k, n)
    tmp = df.withColumn("_p", F.lit(1.0 / n))
    return weighted_sample(tmp, k, "_p", seed, stream, prob_out="_p").drop("_p").withColumn("w", F.lit(1.0))


def leverage_coreset(df: DataFrame, k: int, augmented: bool = True, round_up: bool = True,
                     p: float = 2.0, fast: bool = False, online: bool = False,
                     precomputed: str | None = None, seed: int = 0, n: int | None = None,
                     d: int | None = None, persist: bool = True):
    """D3: scores -> augment -> round up -> probabilities -> weights 1/(p k) -> race sample.

    Returns (coreset, scored) where scored carries the final ``score`` for reuse (C22);
    the coreset carries p = score / sum(score) and w.
    """
    n = int(df.count()) if n is None else n
    _check_size(k, n)
    if precomputed:
        scored = df.withColumnRenamed(precomputed, "score") if precomputed != "score" else df
    elif online:
        scored = S.online_leverage_scores(df, d=d, n=n)
    else:
        scored = S.leverage_scores(df, p=p, d=d, fast=fast, seed=seed, n=n)
    s = F.col("score")
    if augmented:
        s = S.augment(s, n)
    if round_up:
        s = S.round_up(s)
    scored = scored.withColumn("score", s)
    if persist:
        scored = scored.persist()
    core = weighted_sample(scored, k, "score", seed, "lev").withColumn("w", S.importance_weight(F.col("p"), k))
    return core, scored


def coreset_size(size, n: int, max_fraction: float = 1.0) -> int:
    """Rows to draw from n: a positive count (at most n), or a fraction in (0, max_fraction] of n, rounded, at least 1."""
    import numbers

    whole = isinstance(size, numbers.Integral) and not isinstance(size, bool)
    top = float("inf") if whole else max_fraction
    if not (whole or isinstance(size, numbers.Real)) or isinstance(size, bool) or not 0 < size <= top:
        raise ValueError(f"size: a positive count or a fraction up to {max_fraction}, not {size!r}")
    return min(int(size), n) if whole else max(1, math.floor(n * size + 0.5))


def lewis_coreset(df: DataFrame, k, fast: bool = True, precomputed: str | None = None,
                  seed: int = 0, n: int | None = None, d: int | None = None, basis: str | None = None,
                  jl_dim: int = S.JL_DIM):
    """Lewis weights (basis exact / sketch / gauss) -> probabilities -> race sample.

    ``k`` may be an int or a fraction of n. Returns (coreset with p and w, scored).
    """
    n = int(df.count()) if n is None else n
    k = coreset_size(k, n)
    scored = df.withColumnRenamed(precomputed, "score") if precomputed else \
        S.lewis_weights(df, fast=fast, d=d, n=n, seed=seed, basis=basis, jl_dim=jl_dim)
    scored = scored.persist()
    core = weighted_sample(scored, k, "score", seed, "lewis").withColumn("w", S.importance_weight(F.col("p"), k))
    return core, scored


def root_leverage_coreset(df: DataFrame, k: int, seed: int = 0, n: int | None = None,
                          d: int | None = None):
    """Root-leverage (sketched) scores -> probabilities -> weights -> race sample."""
    n = int(df.count()) if n is None else n
    scored = S.root_leverage_scores(df, d=d, n=n, seed=seed).persist()
    core = weighted_sample(scored, k, "score", seed, "logit").withColumn("w", S.importance_weight(F.col("p"), k))
    return core, scored


def multi_sample(df: DataFrame, sizes, runs, weight: str = "p", seed: int = 0, stream: str = "sweep",
                 prob_out: str = "p") -> DataFrame:
    """One race sample per run; the sample of size k in run r is its k smallest keys.

    Each (size, run) config has the exact law of D2; samples of different sizes
    in one run are nested (share keys), samples of different runs are independent.
    Rows: run, rank, id, ..., ``prob_out`` = w / sum(w), rank <= max(sizes); a config
    (size, run) is ``rank <= size``. One plain aggregate for sum(w), one hashing pass that keeps
    about 3 x runs x max(size) candidates (a histogram of the keys where that is too few or
    max(size) is above ``TOPK_MAX``), and one window over them.
    """
    sizes = sorted(int(s) for s in sizes)
    kmax = sizes[-1]
    runs = [int(r) for r in runs]
    count, wsum = _weight_totals(df, weight)
    _check_size(kmax, count)
    pos = df.filter(F.col(weight) > 0)
    cand = None
    if kmax <= TOPK_MAX and count > OVERSAMPLE * kmax:
        cand = _run_candidates(pos, kmax, runs, weight, seed, stream, OVERSAMPLE * kmax / wsum)
    if cand is None:
        ex = pos.withColumn("run", F.explode(F.array(*[F.lit(r) for r in runs])))
        key = race_key(F.col(weight), seed, F.concat(F.lit(stream + ":"), F.col("run").cast("string")))
        hist = _histogram(ex, key, F.col(weight), group="run")
        cond = None
        for r, rows in hist.items():
            t, _ = _threshold_from(rows, kmax)
            c = (F.col("run") == r) & (F.lit(True) if t is None else (F.col("_key") <= F.lit(t)))
            cond = c if cond is None else (cond | c)
        cand = ex.withColumn("_key", key).filter(cond)
    if kmax <= TOPK_MAX:
        w = Window.partitionBy("run").orderBy("_key", "id")
        ranked = cand.withColumn("rank", F.row_number().over(w))
    else:
        # ~1.02 kmax candidates per run: number them across range blocks, not in one task per run
        ranked = ordered_rank(cand, "run", ("_key", "id"))
    out = ranked.filter(F.col("rank") <= kmax).drop("_key")
    return out.withColumn(prob_out, F.col(weight) / F.lit(float(wsum)))


def _run_candidates(pos: DataFrame, kmax: int, runs, weight: str, seed: int, stream: str, cut: float):
    """Rows (run, _key) with race key <= cut. Most rows have none and end in compiled filters (a lambda's argument is
    left to Spark's interpreter); the keys of the others are hashed again and exploded. None if a run has fewer than kmax
    (weight concentrated on few rows)."""
    from functools import reduce
    from operator import or_

    from pyspark import StorageLevel

    keys = [(r, race_key(F.col(weight), seed, F.lit(f"{stream}:{r}"))) for r in runs]
    near = pos.where(reduce(or_, [k <= F.lit(cut) for _, k in keys]))
    few = near.withColumn("_rk", F.explode(F.array(*[F.struct(F.lit(r).alias("run"), k.alias("_key")) for r, k in keys])))
    few = few.select(*pos.columns, "_rk.run", "_rk._key").where(F.col("_key") <= F.lit(cut)).persist(StorageLevel.MEMORY_AND_DISK)
    got = {r["run"]: r["count"] for r in few.groupBy("run").count().collect()}
    if all(got.get(r, 0) >= kmax for r in runs):
        return few
    few.unpersist()
    return None


def expand_configs(ranked: DataFrame, sizes, prob: str = "p", weight: str = "importance") -> DataFrame:
    """(run, rank) rows -> (size, run) coreset rows with w."""
    sizes = sorted(int(s) for s in sizes)
    out = ranked.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))) \
        .filter(F.col("rank") <= F.col("size"))
    if weight == "importance":
        return out.withColumn("w", F.lit(1.0) / (F.col(prob) * F.col("size")))
    return out.withColumn("w", F.lit(1.0))


# -- reservoirs (one pass over an order) ---------------------------------------

def reservoir_sample(df: DataFrame, k: int, weight: str = "score", key: str | None = None,
                     seed: int = 0, d: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Chao's weighted reservoir over ``ord`` (first k kept, then accept with
    prob k w / sum w and replace a uniform slot), one reservoir per ``key`` group
    (key=None: the whole order is one reservoir, as in the reference).

    Exact and parallel. Once a row knows its 0-based position r_i in its key's
    (ord, id) order and the inclusive weight sum W_i, its decision needs no other
    row: it writes slot r_i if r_i < k, else slot floor(u2 k) if u1 < k w_i / W_i,
    and every slot ends up holding its LAST writer. So: rows are range-partitioned
    on (key, ord, id) - a hot key spreads over many partitions, ties are split by
    id - one pass gives per-partition key totals (only a partition's first key can
    continue from earlier partitions, so the carry table has at most B rows), one
    streaming pass computes r_i, W_i and the decision and emits only the writers
    (about k (1 + ln(n_key / k)) per key), and a grouped ``max_by`` per
    (key, slot) keeps the last writer. No group is ever gathered in one task.
    Equal to the sequential scan up to the summation order of W_i.
    """
    if k < 1:
        raise ValueError("k must be positive")
    kcol = key if key else "_g"
    cols = list(df.columns)
    src = df if key else df.withColumn("_g", F.lit(0))
    src = src.withColumn("_w", F.col(weight).cast("double")) \
        .withColumn("_u1", R.uniform("id", seed, "res1")).withColumn("_u2", R.uniform("id", seed, "res2"))
    writers = _ordered_writers(src, k, kcol, block_rows)
    payload = F.struct(*[F.col(c) for c in cols])
    last = (writers.groupBy(kcol, "_slot")
            .agg(F.max_by(payload, F.struct("ord", "id")).alias("_row")))
    return last.select("_row.*")


MAX_CARRY_BLOCKS = 100_000


def _range_blocks(src: DataFrame, kcol: str, order, wcol: str | None, block_rows: int | None):
    """Range-partition ``src`` on (kcol, *order) and sort each partition (a hot key spreads
    over many partitions; ties are split by the last order column). Returns the cached
    blocked frame (with ``_blk``) and a broadcast {block: (rows, weight) of its first key
    in earlier blocks}: only a block's first key can continue from earlier blocks, so the
    carry table has at most B entries."""
    import pandas as pd
    from pyspark import StorageLevel

    order = list(order)
    n = src.count()
    if block_rows is None:
        block_rows = max(200_000, int(math.ceil(n / MAX_CARRY_BLOCKS)))
    nblocks = min(MAX_CARRY_BLOCKS, max(1, int(math.ceil(n / block_rows))))
    blocked = (src.repartitionByRange(nblocks, kcol, *order).sortWithinPartitions(kcol, *order)
               .withColumn("_blk", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK))

    def summary(batches):
        first = last = None
        lc, lw, blk, single = 0, 0.0, None, True
        for pdf in batches:
            if len(pdf) == 0:
                continue
            blk = int(pdf["_blk"].iat[0])
            keys = pdf[kcol]
            w = pdf["_w"].to_numpy() if wcol else np.zeros(len(pdf))
            if first is None:
                first = keys.iat[0]
            for kv, c, sw in zip(*_segments(keys, w)):
                if last is not None and kv == last:
                    lc, lw = lc + c, lw + sw
                else:
                    if last is not None:
                        single = False
                    last, lc, lw = kv, c, sw
        if blk is not None:
            yield pd.DataFrame({"blk": [blk], "first": [first], "last": [last], "lc": [lc], "lw": [lw],
                                "single": [single]})

    ktype = src.schema[kcol].dataType.simpleString()
    cols = [kcol, "_blk"] + (["_w"] if wcol else [])
    summ = sorted(blocked.select(*cols).mapInPandas(
        summary, f"blk INT, first {ktype}, last {ktype}, lc BIGINT, lw DOUBLE, single BOOLEAN").collect(),
        key=lambda r: r["blk"])
    carry, open_key, oc, ow = {}, None, 0, 0.0
    for r in summ:
        base = (oc, ow) if open_key is not None and r["first"] == open_key else (0, 0.0)
        carry[r["blk"]] = base
        if r["single"]:
            open_key, oc, ow = r["first"], base[0] + r["lc"], base[1] + r["lw"]
        else:
            open_key, oc, ow = r["last"], r["lc"], r["lw"]
    return blocked, src.sparkSession.sparkContext.broadcast(carry)


def _positions(pdf, kcol, cur, cc, cw, w):
    """0-based position and inclusive weight sum within the key for one sorted batch,
    continuing (cur, cc, cw) from the previous batch."""
    import pandas as pd

    keys = pdf[kcol]
    cont = keys.iat[0] == cur
    seg = np.cumsum(np.r_[0, (keys.iloc[1:].to_numpy() != keys.iloc[:-1].to_numpy()).astype(np.int64)])
    first_seg = seg == 0
    base_c = np.where(first_seg & cont, cc, 0)
    base_w = np.where(first_seg & cont, cw, 0.0)
    r = pd.Series(np.ones(len(w), dtype=np.int64)).groupby(seg).cumsum().to_numpy() - 1 + base_c
    W = pd.Series(w).groupby(seg).cumsum().to_numpy() + base_w
    return r, W, keys.iat[-1]


def ordered_rank(df: DataFrame, key: str, order=("_key", "id"), out: str = "rank",
                 block_rows: int | None = None) -> DataFrame:
    """1-based position of every row within its ``key`` group in ``order`` - the same
    numbers as ``row_number() over (partition by key order by ...)`` - without gathering
    a group in one task: range blocks, at most B carries, one streaming numbering pass."""
    from pyspark.sql.types import LongType, StructField, StructType

    blocked, bcarry = _range_blocks(df, key, order, None, block_rows)
    out_schema = StructType(list(blocked.schema.fields) + [StructField(out, LongType())])

    def number(batches):
        cur, cc = None, 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            pdf = pdf.reset_index(drop=True)
            if cur is None:
                cur = pdf[key].iat[0]
                cc = bcarry.value.get(int(pdf["_blk"].iat[0]), (0, 0.0))[0]
            r, _, last = _positions(pdf, key, cur, cc, 0.0, np.zeros(len(pdf)))
            cur, cc = last, int(r[-1] + 1)
            pdf[out] = r + 1
            yield pdf

    return blocked.mapInPandas(number, out_schema).drop("_blk")


def _ordered_writers(src: DataFrame, k: int, kcol: str, block_rows: int | None) -> DataFrame:
    """Rows of ``src`` (with _w, _u1, _u2) that write a reservoir slot, plus ``_slot``."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    blocked, bcarry = _range_blocks(src, kcol, ("ord", "id"), "_w", block_rows)
    out_schema = StructType(list(blocked.schema.fields) + [StructField("_slot", IntegerType())])

    def decide(batches):
        cur, cc, cw = None, 0, 0.0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            pdf = pdf.reset_index(drop=True)
            if cur is None:
                cur = pdf[kcol].iat[0]
                cc, cw = bcarry.value.get(int(pdf["_blk"].iat[0]), (0, 0.0))
            w = pdf["_w"].to_numpy()
            r, W, last = _positions(pdf, kcol, cur, cc, cw, w)
            with np.errstate(divide="ignore", invalid="ignore"):
                acc = (W > 0) & (pdf["_u1"].to_numpy() < k * w / np.where(W > 0, W, 1.0))
            slot = np.where(r < k, r, np.floor(pdf["_u2"].to_numpy() * k).astype(np.int64) % k)
            take = (r < k) | acc
            cur, cc, cw = last, int(r[-1] + 1), float(W[-1])
            if take.any():
                sel = pdf[take].copy()
                sel["_slot"] = slot[take].astype(np.int32)
                yield sel

    from pyspark import StorageLevel

    # the writers are few (about k (1 + ln(n_key / k)) per key): keep them and release
    # the n-row blocked cache before returning
    writers = blocked.mapInPandas(decide, out_schema).persist(StorageLevel.MEMORY_AND_DISK)
    writers.count()
    blocked.unpersist()
    return writers


def _segments(keys, w):
    """(key, count, weight sum) per run of equal consecutive keys."""
    kv = keys.to_numpy()
    brk = np.r_[True, kv[1:] != kv[:-1]]
    starts = np.flatnonzero(brk)
    counts = np.diff(np.r_[starts, len(kv)])
    sums = np.add.reduceat(w, starts) if len(w) else np.array([])
    return kv[starts], counts, sums


def ridge_accepts(A: np.ndarray, total: float, seen: int, X: np.ndarray, u1: np.ndarray, u2: np.ndarray, k: int, extra: float):
    """One run of rows through the ridge reservoir: ([(row, slot)] accepted in order, A, weight sum, rows seen).

    A changes only with an accepted row, so all rows up to the next accepted one are weighed at once against the
    same inverse; the look-ahead doubles while nothing is accepted (about k (1 + ln(n / k)) rows of n are).
    """
    taken, i, look = [], 0, 16
    inv = np.linalg.inv(A)
    while i < len(X):
        e = min(len(X), i + look) if seen >= k else i + 1
        Z = X[i:e]
        weight = np.minimum(np.einsum("ni,ni->n", Z @ inv, Z), 1.0) + extra
        upto = np.cumsum(np.r_[total, weight])[1:]
        hits = np.flatnonzero((upto > 0) & (u1[i:e] * upto < k * weight)) if seen >= k else [0]
        if len(hits) == 0:
            total, seen, i, look = float(upto[-1]), seen + e - i, e, min(2 * look, 8192)
            continue
        h = int(hits[0])
        taken.append((i + h, seen if seen < k else int(u2[i + h] * k) % k))
        total, seen = float(upto[h]), seen + h + 1
        A = A + np.outer(X[i + h], X[i + h])
        inv = np.linalg.inv(A)
        i, look = i + h + 1, 16
    return taken, A, total, seen


def online_ridge_sample(df: DataFrame, k: int, key: str, c: float | None = None, lam: float = 1e-6,
                        seed: int = 0, d: int | None = None) -> DataFrame:
    """D7, one reservoir per ``key``: weight min(x^T A^-1 x, 1) + c; accepted rows enter A; w = 1.

    Each acceptance changes the matrix that the next score uses, so a key's rows are read in
    (ord, id) order by one task; use ``race`` samplers for one sample of a whole table. Rows are hash-partitioned
    by key and sorted; a task streams its Arrow batches and keeps the current key's state only (k slots, the
    weight sum and A), so memory doesn't grow with the group.
    """
    import pandas as pd

    from .moments import array_width

    d = array_width(df) if d is None else d
    src = df.withColumn("_u1", R.uniform("id", seed, "res1")).withColumn("_u2", R.uniform("id", seed, "res2"))
    cols = list(df.columns)
    parted = src.repartition(key).sortWithinPartitions(key, "ord", "id")
    extra = 0.0 if c is None else c

    def run(batches):
        group, state, held = None, None, {}
        for pdf in batches:
            for _, rows in pdf.groupby((pdf[key] != pdf[key].shift()).cumsum(), sort=False):
                if state is None or rows[key].iat[0] != group:
                    if state is not None:
                        yield pd.DataFrame(list(held.values()), columns=cols)
                    group, state, held = rows[key].iat[0], (lam * np.eye(d), 0.0, 0), {}
                X = np.stack(rows["x"].to_numpy()).astype(float).reshape(-1, d)
                taken, *state = ridge_accepts(*state, X, rows["_u1"].to_numpy(), rows["_u2"].to_numpy(), k, extra)
                kept = rows[cols].iloc[[i for i, _ in taken]].itertuples(index=False, name=None)
                held.update(zip((s for _, s in taken), kept))
        if state is not None:
            yield pd.DataFrame(list(held.values()), columns=cols)

    return parted.mapInPandas(run, df.schema).withColumn("w", F.lit(1.0))
