"""Registered queries on the driver's test tables and their DuckDB oracles.

Each query takes (spark, sf_dir) and returns a DataFrame over the WHOLE tables.
Doubles are rounded after scaling to O(1) so that the two engines' different
summation orders cannot change the compared values.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import pnormal as PN
from ..operators import moments as MO
from ..operators import probit as P
from ..operators import sampling as SM
from ..operators import scores as S
from ..sources import tables as T
from . import oracles as O

BETA_FIXED = [0.3, -0.2, 0.1, 0.05, -0.4]
K_SAMPLE = 500
RIDGE_LAM = 1000.0


# ---------------------------------------------------------------- design layer

def q_design_l4(spark, sf):
    """Standardised lineitem design with intercept."""
    des = T.lineitem_design(spark, sf)
    return des.wide(O.R6).select("id", "y", *[f"x_{j}" for j in range(des.d)])


def sql_design_l4():
    xs = ", ".join(f"round(x{j}, 6) AS x_{j}" for j in range(5))
    return f"WITH {O.l4_cte()}\nSELECT id, y, {xs} FROM l4"


def q_design_customer(spark, sf):
    """Mixed scaled/unscaled columns; constant and single-non-zero columns dropped."""
    df = T.table(spark, sf, "customer")
    from ..sources.design import DesignSpec, build_design

    feats = {"c_nationkey": "c_nationkey", "always_one": (F.col("c_custkey") >= 0).cast("double"),
             "first_only": (F.col("c_custkey") == 1).cast("double")}
    for s in T.MKT_SEGMENTS:
        feats[f"seg_{s.lower()}"] = (F.col("c_mktsegment") == s).cast("double")
    spec = DesignSpec(id="c_custkey", features=feats, label=F.col("c_acctbal") > 0,
                      standardize=["c_nationkey"], drop_constant=True, drop_single_nonzero=True)
    des = build_design(df, spec)
    return des.wide(O.R6).select("id", "y", *[f"x_{j}" for j in range(des.d)])


def sql_design_customer():
    feats = [("c_nationkey", True)] + [(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0 ELSE 0.0 END", False)
                                       for s in T.MKT_SEGMENTS]
    cte = O.design_cte("c1", "customer", "c_custkey", "c_acctbal > 0", feats)
    xs = ", ".join(f"round(x{j}, 6) AS x_{j}" for j in range(7))
    return f"WITH {cte}\nSELECT id, y, {xs} FROM c1"


# Stand-in inputs for the dataset recipes: lineitem / part columns renamed into the
# recipe's schema by a fixed rule (the recipes themselves do all the work).
_LI_SOURCES = [
    ("l_extendedprice", "l_extendedprice"), ("l_quantity", "l_quantity"), ("l_discount", "l_discount"),
    ("l_tax", "l_tax"), ("l_linenumber", "l_linenumber"), ("l_partkey", "l_partkey"),
    ("l_suppkey", "l_suppkey"), ("dayofyear(l_shipdate)", "dayofyear(l_shipdate)"),
    ("month(l_shipdate)", "month(l_shipdate)"), ("year(l_shipdate)", "year(l_shipdate)"),
    ("l_orderkey", "l_orderkey"), ("dayofmonth(l_shipdate)", "dayofmonth(l_shipdate)"),
]
_CT_BINARY = [("Wilderness_Area1", "l_linestatus = 'O'"), ("Soil_Type1", "l_discount = 0"),
              ("Soil_Type2", "l_tax = 0")]


def _covertype_standin(spark, sf):
    from ..sources.recipes import COVERTYPE_CONTINUOUS

    li = T.table(spark, sf, "lineitem")
    cols = [T.lineitem_id().alias("id")]
    cols += [F.expr(src).alias(name) for name, (src, _) in zip(COVERTYPE_CONTINUOUS, _LI_SOURCES)]
    cols += [F.expr(cond).cast("int").alias(name) for name, cond in _CT_BINARY]
    cols.append(F.expr("CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END").alias("Cover_Type"))
    return li.select(*cols)


def q_design_covertype_li(spark, sf):
    """A11 (B1, B4, B5): cover type recipe on a lineitem stand-in: 10 scaled continuous
    columns, binary columns kept, y = +1 iff Cover_Type 2, intercept."""
    from ..sources.recipes import covertype_design

    des = covertype_design(_covertype_standin(spark, sf), "id")
    return des.wide(O.R6).select("id", "y", *[f"x_{j}" for j in range(des.d)])


def sql_design_covertype_li():
    feats = [(src, True) for _, src in _LI_SOURCES[:10]]
    feats += [(f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END", False) for _, cond in _CT_BINARY]
    cte = O.design_cte("ct", "lineitem", O.L4_ID, "l_returnflag = 'R'", feats)
    xs = ", ".join(f"round(x{j}, 6) AS x_{j}" for j in range(len(feats) + 1))
    return f"WITH {cte}\nSELECT id, y, {xs} FROM ct"


def _kdd_source(i):
    src = _LI_SOURCES[i % len(_LI_SOURCES)][1]
    return f"({src}) * {1 + i // len(_LI_SOURCES)}"


def q_design_kddcup_li(spark, sf):
    """A12 (B2, B4, B6): intrusion recipe on a lineitem stand-in: the 34 listed continuous
    columns, num_outbound_cmds dropped, the rest scaled, y = -1 iff label 'normal.'."""
    from ..sources.recipes import KDD_CONTINUOUS, kddcup_design

    li = T.table(spark, sf, "lineitem")
    cols = [T.lineitem_id().alias("id")]
    cols += [F.expr(_kdd_source(i)).alias(name) for i, name in enumerate(KDD_CONTINUOUS)]
    cols.append(F.expr("CASE WHEN l_returnflag = 'N' THEN 'normal.' ELSE 'attack.' END").alias("labels"))
    des = kddcup_design(li.select(*cols), "id")
    return des.wide(O.R6).select("id", "y", *[f"x_{j}" for j in range(des.d)])


def sql_design_kddcup_li():
    from ..sources.recipes import KDD_CONTINUOUS, KDD_DROP

    feats = [(_kdd_source(i), True) for i, name in enumerate(KDD_CONTINUOUS) if name not in KDD_DROP]
    cte = O.design_cte("kd", "lineitem", O.L4_ID, "l_returnflag <> 'N'", feats)
    xs = ", ".join(f"round(x{j}, 6) AS x_{j}" for j in range(len(feats) + 1))
    return f"WITH {cte}\nSELECT id, y, {xs} FROM kd"


_WS_FEATURES = [("p_size", "p_size"), ("p_retailprice", "p_retailprice"),
                ("name_len", "length(p_name)"), ("type_len", "length(p_type)")]


def q_design_webspam_part(spark, sf):
    """A13 (B4, B7, B8): web spam recipe on a part stand-in (numeric columns + LABEL):
    constant and single-non-zero columns dropped, all kept columns scaled, intercept."""
    from ..sources.recipes import webspam_design

    pt = T.table(spark, sf, "part")
    cols = [F.col("p_partkey").alias("id")] + [F.expr(src).alias(name) for name, src in _WS_FEATURES]
    cols.append(F.expr("CASE WHEN p_brand LIKE 'Brand#1%' THEN 1 ELSE -1 END").alias("LABEL"))
    des = webspam_design(pt.select(*cols), "id")
    return des.wide(O.R6).select("id", "y", *[f"x_{j}" for j in range(des.d)])


def sql_design_webspam_part():
    feats = [(src, True) for _, src in _WS_FEATURES]
    cte = O.design_cte("ws", "part", "p_partkey", "p_brand LIKE 'Brand#1%'", feats)
    xs = ", ".join(f"round(x{j}, 6) AS x_{j}" for j in range(len(feats) + 1))
    return f"WITH {cte}\nSELECT id, y, {xs} FROM ws"


def q_validate_l4(spark, sf):
    """One validation aggregate (n, d, label counts)."""
    des = T.lineitem_design(spark, sf)
    return des.df.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("d_min"),
                      F.max(F.size("x")).alias("d_max"),
                      F.sum((F.col("y") == 1).cast("long")).alias("n_pos"),
                      F.sum((F.col("y") == -1).cast("long")).alias("n_neg"))


def sql_validate_l4():
    return (f"WITH {O.l4_cte()}\nSELECT count(*) AS n, 5 AS d_min, 5 AS d_max, "
            "CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos, "
            "CAST(sum(CASE WHEN y = -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg FROM l4")


# ---------------------------------------------------------------- moments

def q_gram_l4(spark, sf):
    """C1 (native path): X^T X / n in long form."""
    des = T.lineitem_design(spark, sf)
    return MO.gram_table(des.df, des.d).select("i", "j", F.round(F.col("value") / des.n, 6).alias("value"))


def sql_gram_l4():
    parts = []
    for i in range(5):
        for j in range(i, 5):
            parts.append(f"SELECT {i} AS i, {j} AS j, round(sum(x{i} * x{j}) / max(n), 6) AS value FROM l4")
    return f"WITH {O.l4_cte()}\n" + "\nUNION ALL\n".join(parts)


def q_gram_v64(spark, sf):
    """C1 (Arrow path, d = 64): X^T X / n in long form."""
    des = T.embeddings_design(spark, sf)
    return MO.gram_table(des.df, des.d).select("i", "j", F.round(F.col("value") / des.n, 6).alias("value"))


def sql_gram_v64():
    return ("WITH e AS (SELECT vec_id, r.k AS k, CAST(embedding[r.k + 1] AS DOUBLE) AS v "
            "FROM embeddings CROSS JOIN range(0, 64) AS r(k)),\n"
            "n AS (SELECT count(*) AS n FROM embeddings)\n"
            "SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, "
            "round(sum(a.v * b.v) / max(n.n), 6) AS value "
            "FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.k <= b.k CROSS JOIN n GROUP BY a.k, b.k")


# ---------------------------------------------------------------- scores

def q_leverage_o1(spark, sf):
    """C7 / C16 on orders (d = 2): n * leverage."""
    des = T.orders_design(spark, sf)
    return S.leverage_scores(des.df, d=des.d).select("id", F.round(F.col("score") * des.n, 6).alias("score_n"))


def sql_leverage_o1():
    return f"WITH {O.o1_cte()}\nSELECT id, round(1 + x0 * x0, 6) AS score_n FROM o1"


def q_leverage_l4(spark, sf):
    """Exact l2 leverage on lineitem (d = 5)."""
    des = T.lineitem_design(spark, sf)
    return S.leverage_scores(des.df, d=des.d).select("id", F.round(F.col("score") * des.n, 6).alias("score_n"))


def sql_leverage_l4():
    return (f"WITH {O.l4_cte()},\n{O.leverage_cte('lev', 'l4', 5)}\n"
            "SELECT id, round(score * n, 6) AS score_n FROM lev")


def q_leverage_p1_l4(spark, sf):
    """C7 with p = 1: ||Q_i||_1 of the QR basis (Cholesky R of the Gram)."""
    des = T.lineitem_design(spark, sf)
    return S.leverage_scores(des.df, p=1.0, d=des.d).select(
        "id", F.round(F.col("score") * math.sqrt(des.n), 6).alias("score_rn"))


def sql_leverage_p1_l4():
    g = O.gram_cte("lg", "l4", 5)
    ch, fin = O.cholesky_inverse_ctes("lc", "lg", 5)
    q = O.q_of_x_sql(5, fin)
    score = " + ".join(f"abs({t})" for t in q)
    return (f"WITH {O.l4_cte()},\n{g},\n{ch}\n"
            f"SELECT id, round(({score}) * sqrt(n), 6) AS score_rn FROM l4, {fin}")


def q_ridge_leverage_l4(spark, sf):
    """C12 (batch): x^T (X^T X + lam I)^-1 x with lam = 1000."""
    des = T.lineitem_design(spark, sf)
    return S.ridge_leverage_scores(des.df, RIDGE_LAM, des.d).select(
        "id", F.round(F.col("score") * des.n, 6).alias("score_n"))


def sql_ridge_leverage_l4():
    return (f"WITH {O.l4_cte()},\n{O.leverage_cte('lev', 'l4', 5, ridge=RIDGE_LAM)}\n"
            "SELECT id, round(score * n, 6) AS score_n FROM lev")


def _lev_post(spark, sf, k=K_SAMPLE):
    des = T.lineitem_design(spark, sf)
    sc = S.leverage_scores(des.df, d=des.d)
    sc = sc.withColumn("aug", S.augment(F.col("score"), des.n))
    sc = sc.withColumn("rounded", S.round_up(F.col("aug")))
    sc = S.probabilities(sc, "rounded", "p")
    return des, sc.withColumn("w", S.importance_weight(F.col("p"), k))


def q_coreset_probs_l4(spark, sf):
    """Augment, round up, normalise, weight, and back to probability."""
    des, sc = _lev_post(spark, sf)
    n = des.n
    back = S.probability_from_weight(F.col("w"), K_SAMPLE)
    return sc.select("id", F.round(F.col("aug") * n, 6).alias("aug_n"),
                     F.round(F.col("rounded") * n, 6).alias("rounded_n"),
                     F.round(F.col("p") * n, 6).alias("p_n"), F.round("w", 6).alias("w"),
                     F.round(back * n, 6).alias("p_back_n"))


def _sql_lev_post(k=K_SAMPLE):
    return (f"WITH {O.l4_cte()},\n{O.leverage_cte('lev', 'l4', 5)},\n"
            "aug AS (SELECT *, score + 1.0 / n AS aug FROM lev),\n"
            f"rnd AS (SELECT *, {O.round_up_sql('aug')} AS rounded FROM aug),\n"
            "tot AS (SELECT sum(rounded) AS tot FROM rnd),\n"
            f"prob AS (SELECT rnd.*, rounded / tot AS p, 1.0 / (rounded / tot * {k}) AS w FROM rnd, tot)\n")


def sql_coreset_probs_l4():
    return (_sql_lev_post() + "SELECT id, round(aug * n, 6) AS aug_n, round(rounded * n, 6) AS rounded_n, "
            f"round(p * n, 6) AS p_n, round(w, 6) AS w, round(1.0 / (w * {K_SAMPLE}) * n, 6) AS p_back_n FROM prob")


def q_online_leverage_ev(spark, sf):
    """Online (prefix) leverage in event_id order, pinv method."""
    des = T.events_design(spark, sf)
    sc = S.online_leverage_scores(des.df, d=des.d, n=des.n, block_rows=2_000)
    return sc.select("id", F.round("score", 8).alias("score"))


def sql_online_leverage_ev():
    return (f"WITH {O.ev_cte()},\n"
            "run AS (SELECT id, x0, count(*) OVER w AS c, sum(x0) OVER w AS s1, sum(x0 * x0) OVER w AS s2 "
            "FROM ev WINDOW w AS (ORDER BY ord, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),\n"
            "t AS (SELECT id, c * s2 - s1 * s1 AS det, "
            "(c * x0 * x0 - 2 * s1 * x0 + s2) AS num, c, s2 FROM run)\n"
            "SELECT id, round(greatest(0.0, least(1.0, CASE WHEN det > 1e-9 * (c * s2 + c) THEN num / det "
            "ELSE 1.0 / c END)), 8) AS score FROM t")


def q_online_leverage_solve_ev(spark, sf):
    """Online leverage with the 'solve' method (clipped above only)."""
    des = T.events_design(spark, sf)
    sc = S.online_leverage_scores(des.df, d=des.d, n=des.n, method="solve", block_rows=3_000)
    return sc.select("id", F.round("score", 8).alias("score"))


def sql_online_leverage_solve_ev():
    return sql_online_leverage_ev().replace("greatest(0.0, least(1.0, ", "(least(1.0, ")


def q_lewis_o1(spark, sf):
    """C17: exact l1 Lewis weights, T = 20, + 1/n (orders, d = 2)."""
    des = T.orders_design(spark, sf)
    sc = S.lewis_weights(des.df, T=20, d=des.d, n=des.n)
    return sc.select("id", F.round(F.col("score") * des.n, 6).alias("score_n"))


def sql_lewis_o1(T_=20):
    ctes = [O.o1_cte(), "w0 AS (SELECT id, x0, x1, n, CAST(1.0 AS DOUBLE) AS w FROM o1)"]
    for t in range(1, T_ + 1):
        ctes.append(f"g{t} AS (SELECT sum(x0 * x0 / w) AS a, sum(x0 * x1 / w) AS b, sum(x1 * x1 / w) AS c "
                    f"FROM w{t - 1} WHERE w > 0)")
        ctes.append(f"w{t} AS (SELECT id, x0, x1, n, sqrt((c * x0 * x0 - 2 * b * x0 * x1 + a * x1 * x1) "
                    f"/ (a * c - b * b)) AS w FROM w{t - 1}, g{t})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT id, round((w + 1.0 / n) * n, 6) AS score_n FROM w{T_}"


# ---------------------------------------------------------------- sketches

def q_countsketch_l4(spark, sf):
    """CountSketch with d^2 buckets (hash bucket, hash sign)."""
    des = T.lineitem_design(spark, sf)
    s = S.sketch_size(des.n, des.d, 2.0)
    return S.countsketch_table(des.df, s, des.d, 2.0, seed=0).select(
        "bucket", "j", F.round("value", 6).alias("value"))


def _sql_sketch(p: float):
    s = 25 if p <= 2 else int(max(25, int(np.power(60000, 1 - 2 / p))))
    fac = "(CASE WHEN {ug} < 0.5 THEN -1.0 ELSE 1.0 END)".format(ug=O.u("id", 0, "cs:g"))
    if p != 2:
        fac += f" * power(-ln({O.u('id', 0, 'cs:e')}), {-1.0 / p!r})"
    sums = ", ".join(f"sum(fac * x{j}) AS v{j}" for j in range(5))
    un = "\nUNION ALL\n".join(f"SELECT bucket, {j} AS j, round(v{j}, 6) AS value FROM sk" for j in range(5))
    return (f"WITH {O.l4_cte()},\nr AS (SELECT x0, x1, x2, x3, x4, "
            f"CAST(floor({O.u('id', 0, 'cs:f')} * {float(s)!r}) AS BIGINT) AS bucket, {fac} AS fac FROM l4),\n"
            f"sk AS (SELECT bucket, {sums} FROM r GROUP BY bucket)\n{un}")


def sql_countsketch_l4():
    return _sql_sketch(2.0)


def q_lp_sketch_l4(spark, sf):
    """l_p sketch (p = 3): rows scaled by Exp(1)^(-1/p), max(d^2, n^(1-2/p)) buckets."""
    des = T.lineitem_design(spark, sf)
    s = S.sketch_size(des.n, des.d, 3.0)
    return S.countsketch_table(des.df, s, des.d, 3.0, seed=0).select(
        "bucket", "j", F.round("value", 6).alias("value"))


def sql_lp_sketch_l4():
    return _sql_sketch(3.0)


def q_fast_leverage_l4(spark, sf):
    """C8 (C2 -> C4 -> C5/C6): sketched leverage: CountSketch, R factor of the sketch,
    basis rows X R^-1 projected by a Gaussian JL(20) matrix, p = 2."""
    des = T.lineitem_design(spark, sf)
    return S.leverage_scores(des.df, d=des.d, fast=True, n=des.n).select(
        "id", F.round(F.col("score") * des.n, 6).alias("score_n"))


def _sql_sketch_scores(root: bool, sample_k: int | None = None, raw: bool = False):
    from ..operators.scores import JL_DIM

    s = 25
    fac = "(CASE WHEN {ug} < 0.5 THEN -1.0 ELSE 1.0 END)".format(ug=O.u("id", 0, "cs:g"))
    sums = ", ".join(f"sum(fac * x{j}) AS v{j}" for j in range(5))
    gcols = ", ".join(f"sum(v{i} * v{j}) AS g{i}_{j}" for i in range(5) for j in range(5))
    ch, fin = O.cholesky_inverse_ctes("sc", "sg", 5)
    q = O.q_of_x_sql(5, fin)
    rng = np.random.default_rng([0, 7919])
    G = rng.normal(loc=0.0, scale=1.0 / np.sqrt(JL_DIM), size=(5, JL_DIM))
    cols = [" + ".join(f"{t} * {float(G[k, c])!r}" for k, t in enumerate(q)) for c in range(JL_DIM)]
    sq = " + ".join(f"power({c}, 2)" for c in cols)
    val = f"(sqrt({sq}) + 1.0 / n) * sqrt(n)" if root else f"({sq}) * n"
    name = "score_rn" if root else "score_n"
    if raw:
        tail = f",\nraw AS (SELECT l4.*, {f'sqrt({sq}) + 1.0 / n' if root else sq} AS score FROM l4, {fin})"
    elif sample_k is None:
        tail = f"SELECT id, round({val}, 6) AS {name} FROM l4, {fin}"
    else:
        tail = (f", sc2 AS (SELECT id, sqrt({sq}) + 1.0 / n AS score FROM l4, {fin}),\n"
                "prob AS (SELECT id, score, score / sum(score) OVER () AS p FROM sc2)\n"
                f"SELECT id, round(1.0 / (p * {sample_k}), 6) AS w FROM prob "
                f"ORDER BY -ln({O.u('id', 0, 'logit')}) / score, id LIMIT {sample_k}")
    return (f"WITH {O.l4_cte()},\nr AS (SELECT x0, x1, x2, x3, x4, "
            f"CAST(floor({O.u('id', 0, 'cs:f')} * {float(s)!r}) AS BIGINT) AS bucket, {fac} AS fac FROM l4),\n"
            f"sk AS (SELECT bucket, {sums} FROM r GROUP BY bucket),\nsg AS (SELECT {gcols} FROM sk),\n{ch}\n"
            + tail)


def sql_fast_leverage_l4():
    return _sql_sketch_scores(False)


def sql_root_leverage_l4():
    return _sql_sketch_scores(True)


def q_root_leverage_l4(spark, sf):
    """Root-leverage score ||Q_i||_2 + 1/n (sketched)."""
    des = T.lineitem_design(spark, sf)
    return S.root_leverage_scores(des.df, d=des.d, n=des.n).select(
        "id", F.round(F.col("score") * math.sqrt(des.n), 6).alias("score_rn"))


def q_root_sample_l4(spark, sf):
    """D5 (C15 + C19 + C20 + D2): root-leverage coreset of k = 500 with importance weights."""
    des = T.lineitem_design(spark, sf)
    core, _ = SM.root_leverage_coreset(des.df, K_SAMPLE, seed=0, n=des.n, d=des.d)
    return core.select("id", F.round("w", 6).alias("w"))


def sql_root_sample_l4():
    return _sql_sketch_scores(True, sample_k=K_SAMPLE)


def q_lewis_sample_o1(spark, sf):
    """D4 (C17 + C19 + C20 + D2): exact l1 Lewis coreset of k = 500 on orders with importance weights."""
    des = T.orders_design(spark, sf)
    core, _ = SM.lewis_coreset(des.df, K_SAMPLE, fast=False, seed=0, n=des.n, d=des.d)
    return core.select("id", F.round("w", 6).alias("w"))


def sql_lewis_sample_o1():
    body = sql_lewis_o1()
    body = body[:body.rindex("\nSELECT")]
    return (body + ",\nsc AS (SELECT id, w + 1.0 / n AS score FROM w20),\n"
            "prob AS (SELECT id, score, score / sum(score) OVER () AS p FROM sc)\n"
            f"SELECT id, round(1.0 / (p * {K_SAMPLE}), 6) AS w FROM prob "
            f"ORDER BY -ln({O.u('id', 0, 'lewis')}) / score, id LIMIT {K_SAMPLE}")


def q_lewis_sketch_o1(spark, sf):
    """Lewis weights with a CountSketch basis (no JL projection), T = 20."""
    des = T.orders_design(spark, sf)
    sc = S.lewis_weights(des.df, T=20, d=des.d, n=des.n, basis="sketch")
    return sc.select("id", F.round(F.col("score") * des.n, 6).alias("score_n"))


def _sql_lewis_sketched(jl: bool, T_=20):
    ctes = [O.o1_cte(), "w0 AS (SELECT id, x0, x1, n, CAST(1.0 AS DOUBLE) AS w FROM o1)"]
    G = None
    if jl:
        rng = np.random.default_rng([0, 7919])
        G = rng.normal(loc=0.0, scale=1.0 / np.sqrt(S.JL_DIM), size=(2, S.JL_DIM))
    for t in range(T_):
        b = f"CAST(floor({O.u('id', 0, f'lw{t}:f')} * 4.0) AS BIGINT)"
        sg = f"(CASE WHEN {O.u('id', 0, f'lw{t}:g')} < 0.5 THEN -1.0 ELSE 1.0 END)"
        ctes.append(f"sk{t} AS (SELECT {b} AS bk, sum({sg} * x0 / sqrt(w)) AS v0, sum({sg} * x1 / sqrt(w)) AS v1 "
                    f"FROM w{t} WHERE w > 0 GROUP BY 1)")
        ctes.append(f"c{t} AS (SELECT sqrt(sum(v0 * v0)) AS l00, sum(v0 * v1) / sqrt(sum(v0 * v0)) AS l10, "
                    f"sqrt(sum(v1 * v1) - sum(v0 * v1) * sum(v0 * v1) / sum(v0 * v0)) AS l11 FROM sk{t})")
        q0 = "(x0 / l00)"
        q1 = "(-l10 / (l00 * l11) * x0 + x1 / l11)"
        if G is None:
            norm = f"{q0} * {q0} + {q1} * {q1}"
        else:
            norm = " + ".join(f"power({q0} * {float(G[0, c])!r} + {q1} * {float(G[1, c])!r}, 2)"
                              for c in range(S.JL_DIM))
        ctes.append(f"w{t + 1} AS (SELECT id, x0, x1, n, sqrt({norm}) AS w FROM w{t}, c{t})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT id, round((w + 1.0 / n) * n, 6) AS score_n FROM w{T_}"


def sql_lewis_sketch_o1():
    return _sql_lewis_sketched(False)


def sql_lewis_fast_o1():
    return _sql_lewis_sketched(True)


def q_lewis_fast_o1(spark, sf):
    """Sketched Lewis weights (T = 20)."""
    des = T.orders_design(spark, sf)
    sc = S.lewis_weights(des.df, T=20, fast=True, d=des.d, n=des.n)
    return sc.select("id", F.round(F.col("score") * des.n, 6).alias("score_n"))


# ---------------------------------------------------------------- sampling

def q_uniform_sample_l4(spark, sf):
    """Exactly k = 500 rows uniformly without replacement."""
    des = T.lineitem_design(spark, sf)
    return SM.uniform_sample(des.df, K_SAMPLE, seed=0, n=des.n).select("id", "w")


def sql_uniform_sample_l4():
    return (f"WITH {O.l4_cte()}\nSELECT id, CAST(1.0 AS DOUBLE) AS w FROM l4 "
            f"ORDER BY -ln({O.u('id', 0, 'uniform')}) / (1.0 / n), id LIMIT {K_SAMPLE}")


def q_leverage_sample_l4(spark, sf):
    """D2 + D3: leverage coreset (augmented, rounded) of k = 500 by exponential race keys."""
    des, sc = _lev_post(spark, sf)
    core = SM.weighted_sample(sc.persist(), K_SAMPLE, "p", seed=0, stream="lev")
    return core.select("id", F.round("w", 6).alias("w"))


def sql_leverage_sample_l4():
    return (_sql_lev_post() + f"SELECT id, round(w, 6) AS w FROM prob "
            f"ORDER BY -ln({O.u('id', 0, 'lev')}) / p, id LIMIT {K_SAMPLE}")


def q_multi_sample_l4(spark, sf):
    """Uniform samples for sizes (100, 200, 300) x runs (1, 2, 3), nested per run."""
    des = T.lineitem_design(spark, sf)
    df = des.df.withColumn("wt", F.lit(1.0))
    ranked = SM.multi_sample(df, [100, 200, 300], [1, 2, 3], "wt", seed=0, stream="sweep")
    return SM.expand_configs(ranked, [100, 200, 300], "p", weight="none").select(
        "run", "size", "id", F.col("rank").cast("int").alias("rank"))


def sql_multi_sample_l4():
    key = f"-ln({O.u('id', 0, stream_sql=chr(39) + 'sweep:' + chr(39) + ' || CAST(run AS VARCHAR)')}) / (1.0 / n)"
    return (f"WITH {O.l4_cte()},\nruns AS (SELECT CAST(r AS INTEGER) AS run FROM range(1, 4) t(r)),\n"
            "sizes AS (SELECT CAST(s AS INTEGER) AS size FROM (VALUES (100), (200), (300)) v(s)),\n"
            f"ranked AS (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY {key}, id) AS rk "
            "FROM l4, runs)\n"
            "SELECT run, size, id, CAST(rk AS INTEGER) AS rank FROM ranked, sizes WHERE rk <= size")


# ---------------------------------------------------------------- probit loss

def _loss_query(spark, sf, p, beta=BETA_FIXED, tail="exact"):
    des = T.lineitem_design(spark, sf)
    t = P.loss_columns(des.df, beta, p, tail=tail, with_hess=False)
    x, y, w = F.col("x"), F.col("y").cast("double"), F.col("w")
    n = des.n
    aggs = [F.round(F.sum(w * F.col("_g")) / n, 8).alias("f_n")]
    aggs += [F.round(F.sum(-w * F.col("_gp") * y * x[j]) / n, 8).alias(f"g{j}_n") for j in range(des.d)]
    return t.agg(*aggs)


def _sql_loss(p, beta=BETA_FIXED, tail="exact"):
    gs = ", ".join(f"round(sum(-gp * y * x{j}) / max(n), 8) AS g{j}_n" for j in range(5))
    return (f"WITH {O.l4_cte()},\n{O.loss_select(p, beta, 5, 'l4', tail)}\n"
            f"SELECT round(sum(g) / max(n), 8) AS f_n, {gs} FROM lg")


def q_loss_p1_l4(spark, sf):
    """E6/E7 (p = 1, Laplace closed form) at a fixed beta."""
    return _loss_query(spark, sf, 1.0)


def q_loss_p2_l4(spark, sf):
    """E6/E7 (p = 2, probit) at a fixed beta."""
    return _loss_query(spark, sf, 2.0)


def q_loss_p3_l4(spark, sf):
    """E6/E7 (p = 3, incomplete-gamma kernel) at a fixed beta."""
    return _loss_query(spark, sf, 3.0)


def sql_loss_p1_l4():
    return _sql_loss(1.0)


def sql_loss_p2_l4():
    return _sql_loss(2.0)


def sql_loss_p3_l4():
    return _sql_loss(3.0)


BETA_WIDE = [5 * b for b in BETA_FIXED]  # margins reach past the p = 5 cut-off


def q_loss_p5_reftail_l4(spark, sf):
    """p = 5 loss/gradient with the reference's polynomial tail above the cut-off z > 5."""
    return _loss_query(spark, sf, 5.0, BETA_WIDE, tail="reference")


def sql_loss_p5_reftail_l4():
    return _sql_loss(5.0, BETA_WIDE, tail="reference")


def q_misclassified_l4(spark, sf):
    """Margin x.beta and normalised residual of misclassified rows."""
    des = T.lineitem_design(spark, sf)
    from ..operators.linalg import dot_expr

    nb = float(np.linalg.norm(BETA_FIXED))
    m = dot_expr(F.col("x"), BETA_FIXED)
    return (des.df.withColumn("margin", m).filter(F.col("margin") * F.col("y") < 0)
            .select("id", "y", F.round("margin", 6).alias("margin"),
                    F.round(F.col("margin") / nb, 6).alias("residual")))


def sql_misclassified_l4():
    dot = " + ".join(f"x{j} * {b!r}" for j, b in enumerate(BETA_FIXED))
    nb = float(np.linalg.norm(BETA_FIXED))
    return (f"WITH {O.l4_cte()},\nm AS (SELECT id, y, {dot} AS margin FROM l4)\n"
            f"SELECT id, y, round(margin, 6) AS margin, round(margin / {nb!r}, 6) AS residual "
            "FROM m WHERE margin * y < 0")


def q_boundary_lines_l2(spark, sf):
    """B12 + B13: decision boundaries y = -b0/b1 x - b2/b1 of p = 1 and p = 2 probit fits
    on the two-feature lineitem design (quantity, discount, intercept), 50 points over the
    range of the first feature; rows of the listed methods kept."""
    from ..operators import preprocess as PP

    des = T.lineitem_design(spark, sf, features=["l_quantity", "l_discount"])
    rng = des.df.agg(F.min(F.col("x")[0]).alias("lo"), F.max(F.col("x")[0]).alias("hi")).collect()[0]
    rows = [(m, [float(b) for b in P.fit(des.df, pv, des.d, check=False).beta])
            for m, pv in (("p1", 1.0), ("p2", 2.0))]
    betas = spark.createDataFrame(rows, "method STRING, beta ARRAY<DOUBLE>")
    lines = PP.boundary_lines(betas, float(rng["lo"]), float(rng["hi"]), steps=50)
    return PP.filter_values(lines, "method", ["p1", "p2"]).select(
        "method", F.round("x", 6).alias("x"), F.round("y", 3).alias("y"))


def q_pnormal_grid(spark, sf):
    """Density, CDF, loss and derivative on the grid of distinct scaled quantities."""
    from ..functions.exprs import SqlOps

    ops = SqlOps("spark")
    z = ops.col("z")
    grid = (T.table(spark, sf, "lineitem").select(((F.col("l_quantity") - 25.0) / 5.0).alias("z")).distinct()
            .withColumn("p", F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))))
    outs = []
    for p in (1.0, 2.0, 3.0):
        g = grid.filter(F.col("p") == p).select(
            "z", "p", F.expr(PN.pdf(z, p, ops).sql).alias("pdf"), F.expr(PN.cdf(z, p, ops).sql).alias("cdf"),
            F.expr(PN.loss(z, p, ops).sql).alias("g"), F.expr(PN.loss_grad(z, p, ops).sql).alias("g_grad"))
        outs.append(g)
    wide = outs[0].unionByName(outs[1]).unionByName(outs[2])
    return (wide.unpivot(["z", "p"], ["pdf", "cdf", "g", "g_grad"], "variable", "value")
            .select(F.round("z", 6).alias("z"), "p", "variable", F.round("value", 8).alias("value")))


def sql_pnormal_grid():
    from ..functions.exprs import SqlOps

    ops = SqlOps("duckdb")
    z = ops.col("z")
    parts = []
    for p in (1.0, 2.0, 3.0):
        parts.append(f"SELECT z, CAST({p!r} AS DOUBLE) AS p, {PN.pdf(z, p, ops).sql} AS pdf, "
                     f"{PN.cdf(z, p, ops).sql} AS cdf, {PN.loss(z, p, ops).sql} AS g, "
                     f"{PN.loss_grad(z, p, ops).sql} AS g_grad FROM grid")
    return ("WITH grid AS (SELECT DISTINCT (l_quantity - 25.0) / 5.0 AS z FROM lineitem),\n"
            "wide AS (" + "\nUNION ALL\n".join(parts) + ")\n"
            "SELECT round(z, 6) AS z, p, variable, round(value, 8) AS value FROM "
            "(UNPIVOT wide ON pdf, cdf, g, g_grad INTO NAME variable VALUE value)")


def q_fit_l4(spark, sf):
    """Maximum-likelihood probit fit (p = 2) on the full lineitem design."""
    des = T.lineitem_design(spark, sf)
    des.df = des.df.select("y", "w", "x")  # what a fit reads
    r = P.fit(des.cache().df, 2.0, des.d, check=False)
    rows = [(j, float(b)) for j, b in enumerate(r.beta)]
    return spark.createDataFrame(rows, "j INT, beta DOUBLE").withColumn("beta", F.round("beta", 4))


def sql_fit_l4():
    rows = " UNION ALL ".join(f"SELECT {j} AS j, round(b{j}, 4) AS beta FROM nf" for j in range(5))
    return f"WITH {O.l4_cte()},\n{O.newton_ctes('nf', 'l4', 5, 2.0, 8)}\n{rows}"


def sql_beta_store_o1():
    rows = " UNION ALL ".join(f"SELECT 'orders' AS dataset, CAST(2.0 AS DOUBLE) AS p, {j} AS j, round(b{j}, 6) AS beta FROM nf" for j in range(2))
    return f"WITH {O.o1_cte()},\n{O.newton_ctes('nf', 'o1', 2, 2.0, 8)}\n{rows}"


def sql_boundary_lines_l2():
    cte = O.design_cte("l2", "lineitem", O.L4_ID, "l_returnflag = 'R'", [("l_quantity", True), ("l_discount", True)])
    line = "round(x, 6) AS x, round(-b0 / b1 * x - b2 / b1, 3) AS y"
    return (f"WITH {cte},\n{O.newton_ctes('na', 'l2', 3, 1.0, 9)},\n{O.newton_ctes('nc', 'l2', 3, 2.0, 8)},\n"
            "e AS (SELECT min(x0) AS lo, max(x0) AS hi FROM l2),\n"
            "xs AS (SELECT lo + (hi - lo) * r.i / 49.0 AS x FROM e, range(0, 50) AS r(i))\n"
            f"SELECT 'p1' AS method, {line} FROM xs, na UNION ALL SELECT 'p2' AS method, {line} FROM xs, nc")


def sql_logistic_baseline_l4():
    n = lambda t: f"sqrt({' + '.join(f'{t}.b{j} * {t}.b{j}' for j in range(5))})"
    rows = " UNION ALL ".join(f"SELECT {j} AS j, round(nl.b{j} / {n('nl')}, 3) AS logistic, round(np.b{j} / {n('np')}, 3) AS probit_p1 FROM nl, np"
                              for j in range(5))
    return f"WITH {O.l4_cte()},\n{O.newton_ctes('nl', 'l4', 5, None, 9)},\n{O.newton_ctes('np', 'l4', 5, 1.0, 9)}\n{rows}"


def q_coreset_ratio_l4(spark, sf):
    """D3 + E8 + E13: leverage coreset k = 500, p = 1 fit, ratio on the full data."""
    from .coreset import coreset_ratio

    des = T.lineitem_design(spark, sf)
    return coreset_ratio(des, K_SAMPLE, p=1.0).select(
        "method", "p", "size", "n", "d", F.round("ratio", 6).alias("ratio"), *[F.round(F.col("beta")[j], 4).alias(f"beta_{j}") for j in range(5)])


def sql_coreset_ratio_l4():
    ch, fin = O.cholesky_inverse_ctes("lc", "lg", 5)
    score = " + ".join(f"abs({t})" for t in O.q_of_x_sql(5, fin))
    up = O.round_up_sql("(score + 1.0 / n)")
    return (f"WITH {O.l4_cte()},\n{O.gram_cte('lg', 'l4', 5)},\n{ch},\nlev AS (SELECT l4.*, {score} AS score FROM l4, {fin}),\n"
            f"up AS (SELECT * REPLACE ({up} AS score) FROM lev),\ntot AS (SELECT sum(score) AS t FROM up),\n"
            f"core AS MATERIALIZED (SELECT y, x0, x1, x2, x3, x4, 1.0 / (score / t * {K_SAMPLE}) AS wt FROM up, tot "
            f"ORDER BY -ln({O.u('id', 0, 'lev')}) / score, id LIMIT {K_SAMPLE}),\n"
            f"{O.newton_ctes('nb', 'core', 5, 1.0, 10, 'wt')},\n{O.newton_ctes('nf', 'l4', 5, 1.0, 9)},\n"
            f"{O.loss_of_ctes('lb', 'l4', 'nb', 5, 1.0)},\n{O.loss_of_ctes('lf', 'l4', 'nf', 5, 1.0)}\n"
            f"SELECT 'leverage' AS method, CAST(1.0 AS DOUBLE) AS p, {K_SAMPLE} AS size, (SELECT count(*) FROM l4) AS n, 5 AS d, "
            "round(lb.f / lf.f, 6) AS ratio, " + ", ".join(f"round(b{j}, 4) AS beta_{j}" for j in range(5)) + " FROM lb, lf, nb")


# ---------------------------------------------------------------- more designs

def q_design_documents(spark, sf):
    """A1 + join: documents joined to labels, scaled n_chars + one-hot language, y from quality."""
    des = T.documents_design(spark, sf)
    return des.wide(O.R6).select("id", "y", *[f"x_{j}" for j in range(des.d)])


def sql_design_documents():
    feats = [("n_chars", True)] + [(f"CASE WHEN lang = '{lg}' THEN 1.0 ELSE 0.0 END", False) for lg in T.LANGS]
    src = "(SELECT d.doc_id, d.n_chars, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
    cte = O.design_cte("dl", src, "doc_id", "quality = 1", feats, intercept=False)
    xs = ", ".join(f"round(x{j}, 6) AS x_{j}" for j in range(5))
    return f"WITH {cte}\nSELECT id, y, {xs} FROM dl"


def q_leverage_customer(spark, sf):
    """C7/C16 on a rank-deficient design (one-hot + intercept): pseudo-inverse leverage, sum = rank."""
    des = T.customer_design(spark, sf)
    return S.leverage_scores(des.df, d=des.d).select("id", F.round("score", 8).alias("score"))


def sql_leverage_customer():
    # the intercept is the sum of the segment columns: without it the span is the same and the Gram has full rank
    feats = [("c_nationkey", True)] + [(f"CASE WHEN c_mktsegment = '{g}' THEN 1.0 ELSE 0.0 END", False) for g in T.MKT_SEGMENTS]
    cte = O.design_cte("cu", "customer", "c_custkey", "c_acctbal > 0", feats, intercept=False)
    return f"WITH {cte},\n{O.leverage_cte('lev', 'cu', 6)}\nSELECT id, round(score, 8) AS score FROM lev"


# ---------------------------------------------------------------- streaming

def _ev_stream(spark, sf):
    from ..streaming import online as ST

    return ST, ST.events_vectors(ST.event_stream(spark, sf))


def q_online_leverage_stream_ev(spark, sf):
    """Per-user online leverage over the events stream (x = (value, 1)), watermark 1 hour."""
    ST, rows = _ev_stream(spark, sf)
    out = ST.run_to_table(ST.online_leverage_stream(rows, 2), "s1")
    return out.select(F.col("key").alias("user_id"), "id", F.round("score", 8).alias("score"))


def sql_online_leverage_stream_ev():
    return ("WITH r AS (SELECT user_id, event_id AS id, CAST(value AS DOUBLE) AS v, "
            "count(*) OVER w AS c, sum(value) OVER w AS s1, sum(value * value) OVER w AS s2 FROM events "
            "WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),\n"
            "t AS (SELECT user_id, id, c * s2 - s1 * s1 AS det, c * v * v - 2 * s1 * v + s2 AS num, c, s2 FROM r)\n"
            "SELECT user_id, id, round(greatest(0.0, least(1.0, CASE WHEN det > 1e-9 * (c * s2 + c) THEN num / det "
            "ELSE 1.0 / c END)), 8) AS score FROM t")


def q_countsketch_stream_ev(spark, sf):
    """Streaming CountSketch of (value, 1) rows into 16 buckets (complete mode)."""
    ST, rows = _ev_stream(spark, sf)
    out = ST.run_to_table(ST.countsketch_stream(rows, 16, 2), "s4", mode="complete")
    return out.select("bucket", "j", F.round("value", 6).alias("value"))


def sql_countsketch_stream_ev():
    b = f"CAST(floor({O.u('event_id', 0, 'cs:f')} * 16.0) AS BIGINT)"
    sg = f"(CASE WHEN {O.u('event_id', 0, 'cs:g')} < 0.5 THEN -1.0 ELSE 1.0 END)"
    return (f"WITH r AS (SELECT {b} AS bucket, {sg} AS sg, CAST(value AS DOUBLE) AS v FROM events)\n"
            "SELECT bucket, 0 AS j, round(sum(sg * v), 6) AS value FROM r GROUP BY bucket\n"
            "UNION ALL SELECT bucket, 1 AS j, round(sum(sg), 6) AS value FROM r GROUP BY bucket")


def q_reservoir_stream_ev(spark, sf):
    """Per-user Chao reservoir (k = 5, weight = value) over the events stream."""
    ST, rows = _ev_stream(spark, sf)
    rows = rows.withColumn("wt", F.col("x")[0])
    return ST.run_to_table(ST.reservoir_stream(rows, 5, "wt"), "s2", mode="update", keys=["key", "slot"])


def sql_reservoir_stream_ev():
    return ("WITH r AS (SELECT user_id AS key, event_id AS id, CASE WHEN event_type = 'error' THEN 1 ELSE -1 END AS y,\n"
            "  CAST(value AS DOUBLE) AS w, row_number() OVER o - 1 AS r, sum(CAST(value AS DOUBLE)) OVER o AS sw,\n"
            f"  {O.u('event_id', 0, 'res1')} AS u1, {O.u('event_id', 0, 'res2')} AS u2 FROM events\n"
            "  WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),\n"
            "wr AS (SELECT key, id, y, CASE WHEN r < 5 THEN r ELSE CAST(floor(u2 * 5) AS BIGINT) % 5 END AS slot\n"
            "  FROM r WHERE r < 5 OR (sw > 0 AND u1 < 5 * w / sw))\n"
            "SELECT key, CAST(slot AS INTEGER) AS slot, id, y FROM (SELECT *,\n"
            "  row_number() OVER (PARTITION BY key, slot ORDER BY id DESC) AS q FROM wr) WHERE q = 1")


def q_ridge_stream_ev(spark, sf):
    """S2, adaptive: per-user ridge-leverage reservoir (k = 5, c = 0.01) over the events stream."""
    ST, rows = _ev_stream(spark, sf)
    return ST.run_to_table(ST.ridge_reservoir_stream(rows, 5, 2, c=0.01), "s2r", mode="update", keys=["key", "slot"])


def _ridge_replay(rows_sql: str, c: str, k: int = 5, lam: str = "1e-6") -> str:
    """CTEs replaying the ridge reservoir row by row: ``rows_sql`` gives (key, id, y, v) with x = (v, 1)."""
    weight = "least((v * v * s.d - 2 * v * s.b + s.a) / (s.a * s.d - s.b * s.b), 1)"
    return (f"WITH RECURSIVE src AS ({rows_sql}),\n"
            "r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS rn,\n"
            f"  {O.u('id', 0, 'res1')} AS u1, {O.u('id', 0, 'res2')} AS u2 FROM src),\n"
            f"s(key, rn, a, b, d, total, id, y, slot) AS (SELECT DISTINCT key, 0::BIGINT, {lam}::DOUBLE, 0::DOUBLE, {lam}::DOUBLE, 0::DOUBLE,\n"
            "  NULL::BIGINT, NULL::INTEGER, NULL::BIGINT FROM r UNION ALL\n"
            "  SELECT key, rn, CASE WHEN take THEN a + v * v ELSE a END, CASE WHEN take THEN b + v ELSE b END, CASE WHEN take THEN d + 1 ELSE d END,\n"
            f"    total, id, y, CASE WHEN NOT take THEN NULL WHEN rn <= {k} THEN rn - 1 ELSE CAST(floor(u2 * {k}) AS BIGINT) % {k} END\n"
            f"  FROM (SELECT q.*, rn <= {k} OR (total > 0 AND u1 * total < {k} * w) AS take FROM (\n"
            f"    SELECT s.key, r.rn, s.a, s.b, s.d, s.total + {weight} + {c} AS total, {weight} + {c} AS w, r.id, r.y, r.v, r.u1, r.u2\n"
            "    FROM s JOIN r ON r.key = s.key AND r.rn = s.rn + 1) q)),\n"
            "held AS (SELECT key, slot, id, y FROM (SELECT *, row_number() OVER (PARTITION BY key, slot ORDER BY rn DESC) AS q\n"
            "  FROM s WHERE slot IS NOT NULL) WHERE q = 1)\n")


def sql_ridge_stream_ev():
    rows = ("SELECT user_id AS key, event_id AS id, CASE WHEN event_type = 'error' THEN 1 ELSE -1 END AS y, "
            "CAST(value AS DOUBLE) AS v FROM events")
    return _ridge_replay(rows, "0.01") + "SELECT key, CAST(slot AS INTEGER) AS slot, id, y FROM held"


def q_sgd_stream_ev(spark, sf):
    """S3: streaming mini-batch probit SGD (foreachBatch); final beta as rows."""
    ST, rows = _ev_stream(spark, sf)
    beta = ST.StreamingSGD(2).run(rows)
    return spark.createDataFrame([(j, round(float(b), 8)) for j, b in enumerate(beta)], "j INT, beta DOUBLE")


def sql_sgd_stream_ev():
    # one file is one batch: a single step of rate 0.1 from beta = 0, where g'(0) = 2 phi(0)
    g = "-(CASE WHEN event_type = 'error' THEN 1 ELSE -1 END) * 2 / sqrt(2 * pi())"
    return (f"SELECT 0 AS j, round(-0.1 * avg({g} * CAST(value AS DOUBLE)), 8) AS beta FROM events\n"
            f"UNION ALL SELECT 1 AS j, round(-0.1 * avg({g}), 8) AS beta FROM events")


# ---------------------------------------------------------------- one-pass samplers (batch)

def q_reservoir_ev(spark, sf):
    """Chao weighted reservoir per user (k = 5) in event order, weight = online leverage."""
    des = T.events_design(spark, sf, key=True)
    sc = S.online_leverage_scores(des.df, d=des.d, n=des.n, block_rows=5_000)
    return SM.reservoir_sample(sc, 5, weight="score", key="user_id", d=des.d).select("user_id", "id", "y")


def sql_reservoir_ev():
    body = sql_online_leverage_ev()
    body = body[:body.rindex("\nSELECT")]
    score = "greatest(0.0, least(1.0, CASE WHEN det > 1e-9 * (c * s2 + c) THEN num / det ELSE 1.0 / c END))"
    return (f"{body},\nsc AS (SELECT id, {score} AS w FROM t),\n"
            "r AS (SELECT e.user_id, sc.id, ev.y, w, row_number() OVER o - 1 AS r, sum(w) OVER o AS sw,\n"
            f"  {O.u('sc.id', 0, 'res1')} AS u1, {O.u('sc.id', 0, 'res2')} AS u2\n"
            "  FROM sc JOIN ev ON ev.id = sc.id JOIN events e ON e.event_id = sc.id\n"
            "  WINDOW o AS (PARTITION BY e.user_id ORDER BY sc.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),\n"
            "wr AS (SELECT *, CASE WHEN r < 5 THEN r ELSE CAST(floor(u2 * 5) AS BIGINT) % 5 END AS slot\n"
            "  FROM r WHERE r < 5 OR (sw > 0 AND u1 < 5 * w / sw))\n"
            "SELECT user_id, id, y FROM (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY id DESC) AS q FROM wr) WHERE q = 1")


def q_reservoir_value_ev(spark, sf):
    """Chao weighted reservoir per user (k = 5) in (ts, event_id) order, weight = value."""
    ev = T.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("ord"),
                                            "user_id", "value")
    return SM.reservoir_sample(ev, 5, weight="value", key="user_id", seed=0).select("user_id", "id")


def sql_reservoir_value_ev():
    return ("WITH r AS (SELECT user_id, event_id AS id, ts, value AS w,\n"
            "  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r,\n"
            "  sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id\n"
            "                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sw,\n"
            f"  {O.u('event_id', 0, 'res1')} AS u1, {O.u('event_id', 0, 'res2')} AS u2 FROM events),\n"
            "wr AS (SELECT user_id, id, ts,\n"
            "  CASE WHEN r < 5 THEN r ELSE CAST(floor(u2 * 5) AS BIGINT) % 5 END AS slot\n"
            "  FROM r WHERE r < 5 OR (sw > 0 AND u1 < 5 * w / sw))\n"
            "SELECT user_id, id FROM (SELECT user_id, id,\n"
            "  row_number() OVER (PARTITION BY user_id, slot ORDER BY ts DESC, id DESC) AS q FROM wr)\n"
            "WHERE q = 1")


def q_keyed_sample_ev(spark, sf):
    """D2 per key: 3 events per user without replacement, probability proportional to value."""
    ev = T.table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", "value")
    return SM.keyed_weighted_sample(ev, 3, "value", "user_id", seed=0, stream="user").select("user_id", "id")


def sql_keyed_sample_ev():
    key = f"-ln({O.u('event_id', 0, 'user')}) / value"
    return ("SELECT user_id, id FROM (SELECT user_id, event_id AS id, "
            f"row_number() OVER (PARTITION BY user_id ORDER BY {key}, event_id) AS rk FROM events WHERE value > 0) "
            "WHERE rk <= 3")


def q_online_ridge_ev(spark, sf):
    """Online ridge-leverage reservoir per user (k = 5, c = 1/n), weights 1."""
    des = T.events_design(spark, sf, key=True)
    return SM.online_ridge_sample(des.df, 5, "user_id", c=1.0 / des.n, d=des.d).select("user_id", "id", "y", "w")


def sql_online_ridge_ev():
    body = _ridge_replay("SELECT e.user_id AS key, ev.id, ev.y, ev.x0 AS v FROM ev JOIN events e ON e.event_id = ev.id",
                         "(SELECT 1.0 / count(*) FROM events)")
    body = body.replace("WITH RECURSIVE ", f"WITH RECURSIVE {O.ev_cte()},\n", 1)
    return body + "SELECT key AS user_id, id, y, 1.0 AS w FROM held"


# ---------------------------------------------------------------- models and baselines

def q_sgd_epoch_l4(spark, sf):
    """One random-order SGD epoch (per-partition SGD, averaged); beta rows."""
    des = T.lineitem_design(spark, sf)
    b = P.sgd_epoch(des.df, 2.0, des.d, seed=0)
    return spark.createDataFrame([(j, float(v)) for j, v in enumerate(b)], "j INT, beta DOUBLE")


def q_logistic_baseline_l4(spark, sf):
    """Unpenalised logistic regression on the design's columns vs p = 1 probit, normalised coefficients."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    des = T.lineitem_design(spark, sf).cache()
    # MLlib sets the coefficient of a constant column to 0, so the design's last column is its intercept instead
    data = des.df.select(array_to_vector(F.slice("x", 1, des.d - 1)).alias("features"),
                         F.when(F.col("y") == 1, 1.0).otherwise(0.0).alias("label"))
    lr = LogisticRegression(regParam=0.0, fitIntercept=True, standardization=False, maxIter=200, tol=1e-12).fit(data)
    a = np.append(lr.coefficients.toArray(), lr.intercept)
    b = P.fit(des.df, 1.0, des.d, check=False).beta
    rows = [(j, round(float(a[j] / np.linalg.norm(a)), 3), round(float(b[j] / np.linalg.norm(b)), 3)) for j in range(des.d)]
    return spark.createDataFrame(rows, "j INT, logistic DOUBLE, probit_p1 DOUBLE")


def q_pca_samples_l4(spark, sf):
    """Uniform vs leverage samples (k = 500) projected on two principal components."""
    from ..operators import preprocess as PP

    des = T.lineitem_design(spark, sf, intercept=False)
    mu, V = PP.principal_axes(des.df, des.d, 2)
    uni = SM.uniform_sample(des.df, K_SAMPLE, seed=0, n=des.n)
    lev, _ = SM.leverage_coreset(des.df, K_SAMPLE, n=des.n, d=des.d)
    both = PP.project_2d(uni, mu, V, "uniform").unionByName(PP.project_2d(lev, mu, V, "leverage"))
    return both.select("id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"), "sample")


def _axis_ctes(name: str, cov: str, d: int, squarings: int = 30) -> str:
    """CTE ``name`` (v0.., lam): the leading eigenvector of ``cov`` (c{i}_{j}), its largest entry positive: the matrix is
    squared and scaled to trace 1 again and again until only v v^T is left, whose column of the largest diagonal cell is taken."""
    pairs = [(i, j) for i in range(d) for j in range(d)]
    trace = " + ".join(f"c{i}_{i}" for i in range(d))
    out = [f"{name}0 AS MATERIALIZED (SELECT {', '.join(f'c{i}_{j} / ({trace}) AS c{i}_{j}' for i, j in pairs)} FROM {cov})"]
    for t in range(squarings):
        cells = ", ".join(f"{' + '.join(f'c{i}_{k} * c{k}_{j}' for k in range(d))} AS c{i}_{j}" for i, j in pairs)
        out.append(f"{name}s{t} AS MATERIALIZED (SELECT {cells} FROM {name}{t})")
        out.append(f"{name}{t + 1} AS MATERIALIZED (SELECT {', '.join(f'c{i}_{j} / ({trace}) AS c{i}_{j}' for i, j in pairs)} FROM {name}s{t})")
    top = "greatest(" + ", ".join(f"c{i}_{i}" for i in range(d)) + ")"
    column = lambda i: "CASE " + " ".join(f"WHEN c{j}_{j} = {top} THEN c{i}_{j}" for j in range(d)) + " END"
    out.append(f"{name}v AS MATERIALIZED (SELECT {', '.join(f'({column(i)}) / sqrt({top}) AS v{i}' for i in range(d))} FROM {name}{squarings})")
    lam = " + ".join(f"v{i} * v{j} * c{i}_{j}" for i, j in pairs)
    out.append(f"{name} AS MATERIALIZED (SELECT {name}v.*, {lam} AS lam FROM {name}v, {cov})")
    return ",\n".join(out)


def sql_pca_samples_l4():
    d = 4
    pairs = [(i, j) for i in range(d) for j in range(d)]
    mus = ", ".join(f"avg(x{j}) AS m{j}" for j in range(d))
    cov = ", ".join(f"sum(x{i} * x{j}) / count(*) - avg(x{i}) * avg(x{j}) AS c{i}_{j}" for i, j in pairs)
    rest = ", ".join(f"c{i}_{j} - lam * v{i} * v{j} AS c{i}_{j}" for i, j in pairs)
    pcs = ", ".join(f"round({' + '.join(f'(x{j} - m{j}) * {a}.v{j}' for j in range(d))}, 6) AS {n}" for a, n in (("ax", "pc1"), ("ay", "pc2")))
    uni = f"SELECT *, 'uniform' AS sample FROM (SELECT id, x0, x1, x2, x3 FROM l4 ORDER BY -ln({O.u('id', 0, 'uniform')}) / (1.0 / n), id LIMIT {K_SAMPLE})"
    lev = (f"SELECT *, 'leverage' AS sample FROM (SELECT id, x0, x1, x2, x3 FROM (SELECT *, {O.round_up_sql('(score + 1.0 / n)')} AS r FROM lev) "
           f"ORDER BY -ln({O.u('id', 0, 'lev')}) / r, id LIMIT {K_SAMPLE})")
    return (f"WITH {O.l4_cte()},\n{O.leverage_cte('lev', 'l4', d)},\nmu AS (SELECT {mus} FROM l4),\ncv AS MATERIALIZED (SELECT {cov} FROM l4),\n"
            f"{_axis_ctes('ax', 'cv', d)},\ncw AS MATERIALIZED (SELECT {rest} FROM cv, ax),\n{_axis_ctes('ay', 'cw', d)},\n"
            f"both_ AS ({uni} UNION ALL {lev})\nSELECT id, {pcs}, sample FROM both_, mu, ax, ay")


# ---------------------------------------------------------------- posterior

def _trunc_stages_sql(dialect):
    from ..operators.posterior import truncnorm_stages

    return truncnorm_stages("m", "yd", "u", "z", dialect)


def q_truncnorm_l4(spark, sf):
    """F1: latent z ~ N(x.beta, 1) truncated by the label, one hash uniform per row."""
    from ..functions import random as R
    from ..operators.linalg import dot_expr
    from ..operators.posterior import truncated_normal_column

    des = T.lineitem_design(spark, sf)
    u = R.uniform("id", 0, "gibbs:0")
    z = truncated_normal_column(des.df, dot_expr(F.col("x"), BETA_FIXED), F.col("y"), u, "z")
    return z.select("id", "y", F.round("z", 6).alias("z"))


def _sql_trunc(select_tail: str) -> str:
    dot = " + ".join(f"x{j} * {b!r}" for j, b in enumerate(BETA_FIXED))
    ctes = [O.l4_cte(), f"t0 AS (SELECT l4.*, {dot} AS m, CAST(y AS DOUBLE) AS yd, {O.u('id', 0, 'gibbs:0')} AS u FROM l4)"]
    prev = "t0"
    for i, (name, sql) in enumerate(_trunc_stages_sql("duckdb")):
        cur = f"t{i + 1}"
        ctes.append(f"{cur} AS (SELECT * REPLACE ({sql} AS {name}) FROM {prev})" if name == "_tx" and i > 3
                    else f"{cur} AS (SELECT *, {sql} AS {name} FROM {prev})")
        prev = cur
    return "WITH " + ",\n".join(ctes) + f"\n{select_tail.format(src=prev)}"


def sql_truncnorm_l4():
    return _sql_trunc("SELECT id, y, round(z, 6) AS z FROM {src}")


def q_augmentation_step_l4(spark, sf):
    """one data-augmentation step: latent draws, then X^T z / n (one aggregate)."""
    from ..operators.posterior import augmentation_step

    des = T.lineitem_design(spark, sf)
    _, b = augmentation_step(des.df, BETA_FIXED, des.d, step=0, seed=0)
    return spark.createDataFrame([(j, float(round(v / des.n, 6))) for j, v in enumerate(b)], "j INT, value DOUBLE")


def sql_augmentation_step_l4():
    parts = " UNION ALL ".join(f"SELECT {j} AS j, round(sum(x{j} * z) / max(n), 6) AS value FROM {{src}}"
                               for j in range(5))
    return _sql_trunc(parts)


def _bayes(spark, sf, method, sizes=(200, 400), num_samples=200, online=False):
    from .sweep import bayes_sweep

    return bayes_sweep(T.lineitem_design(spark, sf), method, sizes=list(sizes), runs=[1, 2], num_samples=num_samples, burn_in=50, online=online)


def _rounded_draws(draws):
    return draws.select("run", "size", "chain", "draw", *[F.round(f"beta_{j}", 6).alias(f"beta_{j}") for j in range(5)])


def q_bayes_uniform_l4(spark, sf):
    """H9/H10 + F3: uniform coresets -> Gibbs posterior draws per (run, size)."""
    return _rounded_draws(_bayes(spark, sf, "uniform"))


def q_bayes_leverage_l4(spark, sf):
    """H10 + F3: leverage coresets -> Gibbs posterior draws per (run, size)."""
    return _rounded_draws(_bayes(spark, sf, "leverage"))


def q_bayes_online_l4(spark, sf):
    """H10 + F3: online-leverage coresets -> Gibbs posterior draws per (run, size)."""
    return _rounded_draws(_bayes(spark, sf, "leverage", sizes=(200,), num_samples=100, online=True))


def q_bayes_barrier_l4(spark, sf):
    """F3 over all line items: one chain whose rows stay in barrier tasks (5 draws after 3 steps)."""
    from ..operators.posterior import gibbs_barrier

    des = T.lineitem_design(spark, sf)
    out = gibbs_barrier(des.df, des.d, np.zeros(des.d), 10.0 * np.eye(des.d), 5, 3, "gibbs:whole", 0, des.n)
    return out.select("draw", *[F.round(F.col("beta")[j], 6).alias(f"beta_{j}") for j in range(des.d)])


def _gibbs_ctes(src: str, d: int, steps: int, stream: str) -> str:
    """CTEs replaying one chain over ``src`` (id, y, x0.., f): ``draws`` (step from 0, b0..b{d-1}); ``stream``: SQL text."""
    from ..functions import random as R

    xs = ", ".join(f"x{j}" for j in range(d))
    bs = ", ".join(f"b{j}" for j in range(d))
    cells = ", ".join(f"sum(f * x{i} * x{j}){' + 0.1' if i == j else ''} AS g{i}_{j}" for i in range(d) for j in range(d))
    chol, last = O.cholesky_inverse_ctes("gc", "gg", d)
    noise = []
    for j in range(d):
        u1, u2 = (R.counter_uniform_sql(f"n{h}_{j}", "step") for h in (1, 2))
        noise.append(f"sqrt(-2.0 * ln({u1})) * cos(2.0 * pi() * {u2}) AS e{j}")
    bases = ", ".join(f"{R.counter_base_sql(f"'e{j}#{h}'", stream, 0)} AS n{h}_{j}" for j in range(d) for h in (1, 2))
    li = ", ".join(f"li{i}_{j}" for i in range(d) for j in range(i + 1))
    inner = (f"SELECT q.*, c.step + 1 AS step, {', '.join(f'c.b{j}' for j in range(d))}, "
             f"{' + '.join(f'q.x{j} * c.b{j}' for j in range(d))} AS m FROM chain c CROSS JOIN rows_ q WHERE c.step < {steps - 1}")
    inner = f"SELECT *, {R.counter_uniform_sql('base', 'step')} AS u FROM ({inner})"
    seen = set()
    for name, sql in _trunc_stages_sql("duckdb"):
        inner = f"SELECT * REPLACE ({sql} AS {name}) FROM ({inner})" if name in seen else f"SELECT *, {sql} AS {name} FROM ({inner})"
        seen.add(name)
    # a list's sum: the planner takes very long to look for partial sums below the join
    sums = ", ".join(f"list_sum(list(f * z * x{j})) AS r{j}" for j in range(d))
    summed = f"SELECT step, {sums} FROM ({inner}) GROUP BY step"
    v = [f"({' + '.join(f'li{i}_{j} * r{j}' for j in range(i + 1))} + e{i})" for i in range(d)]
    beta = ", ".join(f"{' + '.join(f'li{i}_{j} * v{i}' for i in range(j, d))} AS b{j}" for j in range(d))
    return (f"gg AS (SELECT {cells} FROM {src}),\n{chol},\n"
            f"par AS MATERIALIZED (SELECT {li}, {bases} FROM {last}),\n"
            f"noise AS MATERIALIZED (SELECT step, {', '.join(noise)} FROM par, (SELECT range AS step FROM range({steps}))),\n"
            f"rows_ AS MATERIALIZED (SELECT CAST(y AS DOUBLE) AS yd, f, {xs}, {R.counter_base_sql('id', stream, 0)} AS base FROM {src}),\n"
            f"chain(step, {bs}) AS (SELECT -1::BIGINT, {', '.join('0.0::DOUBLE' for _ in range(d))} UNION ALL\n"
            f"  SELECT step, {beta} FROM (SELECT step, {li}, {', '.join(f'{e} AS v{i}' for i, e in enumerate(v))}\n"
            f"    FROM ({summed}) CROSS JOIN par JOIN noise USING (step))),\n"
            f"draws AS MATERIALIZED (SELECT * FROM chain WHERE step >= 0)")


def _sql_online_scores(src: str, d: int) -> str:
    """CTE ``onl``: the rows of ``src`` with their online leverage ``score`` in (ord, id) order: prefix Grams by window
    sums, G t = x by elimination. The first d rows (independent here) each bring a new direction: score 1."""
    xs = ", ".join(f"x{j}" for j in range(d))
    sums = ", ".join(f"sum(x{min(i, j)} * x{max(i, j)}) OVER w AS a{i}_{j}" for i in range(d) for j in range(d))
    out = [f"onl_w AS (SELECT *, row_number() OVER w AS rn_, {sums}, {', '.join(f'x{i} AS a{i}_{d}' for i in range(d))} FROM {src} "
           "WINDOW w AS (ORDER BY ord, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"]
    out.append(f"onl_e0 AS MATERIALIZED (SELECT * FROM onl_w WHERE rn_ > {d})")
    for k in range(d):
        cells = [(f"a{k}_{c} / a{k}_{k}" if i == k else f"a{i}_{c} - a{i}_{k} * a{k}_{c} / a{k}_{k}") + f" AS a{i}_{c}" for i in range(d) for c in range(k, d + 1)]
        out.append(f"onl_e{k + 1} AS MATERIALIZED (SELECT * REPLACE ({', '.join(cells)}) FROM onl_e{k})")
    dot = " + ".join(f"x{j} * a{j}_{d}" for j in range(d))
    out.append(f"onl AS MATERIALIZED (SELECT id, y, n, {xs}, greatest(0.0, least(1.0, {dot})) AS score FROM onl_e{d} "
               f"UNION ALL SELECT id, y, n, {xs}, 1.0 FROM onl_w WHERE rn_ <= {d})")
    return ",\n".join(out)


def _sql_scored(online: bool) -> str:
    """WITH RECURSIVE body ending in ``scored``: line items with augmented, rounded leverage (sketched or online)."""
    up = O.round_up_sql("(score + 1.0 / n)")
    if online:
        return f"WITH RECURSIVE {O.l4_cte(ordered=True)},\n{_sql_online_scores('l4', 5)},\nscored AS (SELECT * REPLACE ({up} AS score) FROM onl)"
    return _sql_sketch_scores(False, raw=True).replace("WITH ", "WITH RECURSIVE ", 1) + f",\nscored AS (SELECT * REPLACE ({up} AS score) FROM raw)"


def sql_bayes_barrier_l4():
    return (f"WITH RECURSIVE {O.l4_cte()},\nrows0 AS (SELECT *, 1.0 AS f FROM l4),\n" + _gibbs_ctes("rows0", 5, 8, "'gibbs:whole'")
            + "\nSELECT (step - 3)::INTEGER AS draw, " + ", ".join(f"round(b{j}, 6) AS beta_{j}" for j in range(5)) + " FROM draws WHERE step >= 3")


def q_posterior_distances_l4(spark, sf):
    """Posterior-mean distance, covariance spectral norm and polynomial MMD
    of each (run, size) posterior against the posterior of the largest coreset."""
    from ..operators import distance as D

    dr = _bayes(spark, sf, "leverage").select("run", "size", F.array(*[F.col(f"beta_{j}") for j in range(5)]).alias("beta"))
    dr = dr.persist()
    ref = dr.filter(F.col("size") == 400)
    small = dr.filter(F.col("size") == 200)
    a = D.mean_distance_grouped(small, ref, ["run", "size"])
    b = D.covariance_spectral_grouped(small, ref, ["run", "size"])
    c = D.mmd_polynomial_grouped(small, ref, ["run", "size"], col="beta")
    return a.join(b, ["run", "size"]).join(c, ["run", "size"])


# ---------------------------------------------------------------- distances with oracles

def _ev_vec():
    return F.array((F.col("value") / 100.0).cast("double"), (F.minute("ts") / 60.0).cast("double"))


def _ev_samples(spark, sf):
    ev = T.table(spark, sf, "events").select("event_id", "event_type", _ev_vec().alias("x"))
    return ev.filter(F.col("event_type") == "click"), ev.filter(F.col("event_type") == "view")


def q_bayes_summary_l4(spark, sf):
    """F7 + G2/G3/G7: posterior-mean distance of each (run, size) to the largest coreset's
    posterior, summarised per size (median, quartiles, count), and draws per second."""
    from ..operators import distance as D
    from ..operators import summary as G

    out = _bayes(spark, sf, "uniform").persist()
    dr = out.select("run", "size", F.array(*[F.col(f"beta_{j}") for j in range(5)]).alias("beta"))
    ref = dr.filter(F.col("size") == 400)
    dist = D.mean_distance_grouped(dr.filter(F.col("size") == 200), ref, ["run", "size"])
    summ = G.metric_summary(dist, ["size"], "norm")
    med = G.medians(dist, ["size"], ["norm"]).withColumnRenamed("norm", "median_norm")
    rate = G.draws_per_second(out.select("run", "total_time_s", "reduction_time_s").distinct(), 50, 200)
    return summ.join(med, "size").withColumn("_k", F.lit(0)).join(rate.withColumn("_k", F.lit(0)), "_k").drop("_k")


def q_kernels_ev(spark, sf):
    """Gaussian and polynomial kernel between each user's consecutive events (value, minute)."""
    from pyspark.sql import Window

    from ..operators import distance as D

    ev = T.table(spark, sf, "events").select("event_id", "user_id", _ev_vec().alias("x"))
    before = F.lag("x").over(Window.partitionBy("user_id").orderBy("event_id"))
    both = ev.withColumn("b", before).where(F.col("b").isNotNull())
    return both.select("event_id", F.round(D.gaussian_kernel(F.col("x"), F.col("b")), 8).alias("gaussian"),
                       F.round(D.polynomial_kernel(F.col("x"), F.col("b")), 8).alias("polynomial"))


def sql_kernels_ev():
    return ("WITH e AS (SELECT event_id, value / 100.0 AS a, minute(ts) / 60.0 AS m, lag(value / 100.0) OVER w AS pa, lag(minute(ts) / 60.0) OVER w AS pm\n"
            "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))\n"
            "SELECT event_id, round(exp(-0.5 * (power(a - pa, 2) + power(m - pm, 2))), 8) AS gaussian,\n"
            "round(power(1 + a * pa + m * pm, 2), 8) AS polynomial FROM e WHERE pa IS NOT NULL")


def q_mmd_poly_ev(spark, sf):
    """polynomial-kernel MMD between click and view event vectors (exact, via moments)."""
    from ..operators import distance as D

    a, b = _ev_samples(spark, sf)
    return D.mmd_polynomial(a, b).select(F.round("mmd", 8).alias("mmd"))


def _sql_ev_vec(t):
    return f"(SELECT value / 100.0 AS a0, minute(ts) / 60.0 AS a1 FROM events WHERE event_type = '{t}')"


def sql_mmd_poly_ev():
    k = "power(1 + p.a0 * q.a0 + p.a1 * q.a1, 2)"
    x, y = _sql_ev_vec("click"), _sql_ev_vec("view")
    return (f"WITH kxx AS (SELECT avg({k}) AS v FROM {x} p, {x} q), kyy AS (SELECT avg({k}) AS v FROM {y} p, {y} q), "
            f"kxy AS (SELECT avg({k}) AS v FROM {x} p, {y} q)\n"
            "SELECT round(sqrt(greatest(kxx.v + kyy.v - 2 * kxy.v, 0.0)), 8) AS mmd FROM kxx, kyy, kxy")


RFF_FEATURES = 128


def q_mmd_rff_ev(spark, sf):
    """Gaussian-kernel MMD by random Fourier features (linear time, mergeable)."""
    from ..operators import distance as D

    a, b = _ev_samples(spark, sf)
    return D.mmd_gaussian_rff(a, b, features=RFF_FEATURES, seed=0).select(F.round("mmd", 8).alias("mmd"))


def sql_mmd_rff_ev():
    from ..operators.distance import rff_params

    W, bb = rff_params(2, RFF_FEATURES, 0)
    c = math.sqrt(2.0 / RFF_FEATURES)
    feats = ", ".join(f"avg({c!r} * cos({float(bb[k])!r} + a0 * {float(W[k, 0])!r} + a1 * {float(W[k, 1])!r})) AS f{k}"
                      for k in range(RFF_FEATURES))
    diff = " + ".join(f"(x.f{k} - y.f{k}) * (x.f{k} - y.f{k})" for k in range(RFF_FEATURES))
    return (f"WITH x AS (SELECT {feats} FROM {_sql_ev_vec('click')}), y AS (SELECT {feats} FROM {_sql_ev_vec('view')})\n"
            f"SELECT round(sqrt(greatest({diff}, 0.0)), 8) AS mmd FROM x, y")


def _emb(spark, sf):
    return T.table(spark, sf, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def q_mean_distance_emb(spark, sf):
    """||mean(label group) - mean(all)||_2 over 64-d embeddings."""
    from ..operators import distance as D

    e = _emb(spark, sf)
    return D.mean_distance_grouped(e, e, ["label"], col="x").select("label", F.round("norm", 6).alias("norm"))


def sql_mean_distance_emb():
    return ("WITH e AS (SELECT label, r.k AS k, CAST(embedding[r.k + 1] AS DOUBLE) AS v FROM embeddings "
            "CROSS JOIN range(0, 64) AS r(k)),\n"
            "g AS (SELECT label, k, avg(v) AS m FROM e GROUP BY label, k), a AS (SELECT k, avg(v) AS m FROM e GROUP BY k)\n"
            "SELECT g.label, round(sqrt(sum((g.m - a.m) * (g.m - a.m))), 6) AS norm FROM g JOIN a ON g.k = a.k GROUP BY g.label")


def q_mmd_poly_emb(spark, sf):
    """polynomial MMD of each label group against all embeddings (moments, d = 64)."""
    from ..operators import distance as D

    e = _emb(spark, sf)
    return D.mmd_polynomial_grouped(e, e, ["label"], col="x").select("label", F.round("mmd", 6).alias("mmd"))


def sql_mmd_poly_emb():
    dot = "list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
    k = f"power(1 + {dot}, 2)"
    return (f"WITH yy AS (SELECT avg({k}) AS v FROM embeddings p, embeddings q),\n"
            f"xx AS (SELECT p.label, avg({k}) AS v FROM embeddings p JOIN embeddings q ON p.label = q.label GROUP BY p.label),\n"
            f"xy AS (SELECT p.label, avg({k}) AS v FROM embeddings p, embeddings q GROUP BY p.label)\n"
            "SELECT xx.label, round(sqrt(greatest(xx.v + yy.v - 2 * xy.v, 0.0)), 6) AS mmd "
            "FROM xx JOIN xy ON xx.label = xy.label, yy")


def q_cov_spectral_emb(spark, sf):
    """F8: spectral norm of cov(label group) - cov(all) over 64-d embeddings."""
    from ..operators import distance as D

    e = _emb(spark, sf)
    return D.covariance_spectral_grouped(e, e, ["label"], col="x").select(
        "label", F.round("matrix_norm", 6).alias("matrix_norm"))


def sql_cov_spectral_emb(squarings: int = 26):
    # M = (cov - cov_all)^2 has the squared norm as its largest eigenvalue: with A = M^(2^t) scaled to trace 1,
    # tr(M A) tends to it, whether it is a single one or not
    out = ["e AS MATERIALIZED (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)",
           "pr AS MATERIALIZED (SELECT a.label, a.i, b.i AS j, sum(a.v * b.v) AS s FROM e a JOIN e b USING (vec_id) GROUP BY a.label, a.i, b.i)",
           "mu AS MATERIALIZED (SELECT label, i, sum(v) AS s, count(*) AS n FROM e GROUP BY label, i)",
           "mu0 AS MATERIALIZED (SELECT i, sum(s) AS s, sum(n) AS n FROM mu GROUP BY i)",
           "c0 AS MATERIALIZED (SELECT i, j, (p.s - a.s * b.s / a.n) / (a.n - 1) AS c FROM (SELECT i, j, sum(s) AS s FROM pr GROUP BY i, j) p "
           "JOIN mu0 a USING (i) JOIN (SELECT i AS j, s FROM mu0) b USING (j))",
           "dm AS MATERIALIZED (SELECT label, i, j, (p.s - a.s * b.s / a.n) / (a.n - 1) - c0.c AS v FROM pr p "
           "JOIN mu a USING (label, i) JOIN (SELECT label, i AS j, s FROM mu) b USING (label, j) JOIN c0 USING (i, j))"]
    times = "SELECT a.label, a.i, b.j, sum(a.v * b.v) AS v FROM {0} a JOIN {0} b ON a.label = b.label AND a.j = b.i GROUP BY a.label, a.i, b.j"
    scaled = "SELECT label, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY label) AS v FROM ({0})"
    out += [f"m AS MATERIALIZED ({times.format('dm')})", f"a0 AS MATERIALIZED ({scaled.format('SELECT * FROM m')})"]
    out += [f"a{t + 1} AS MATERIALIZED ({scaled.format(times.format(f'a{t}'))})" for t in range(squarings)]
    return ("WITH " + ",\n".join(out) + f"\nSELECT m.label, round(sqrt(sum(m.v * a.v)), 6) AS matrix_norm FROM m JOIN a{squarings} a "
            "ON m.label = a.label AND m.i = a.j AND m.j = a.i GROUP BY m.label")


def q_coef_stats_emb(spark, sf):
    """mean and population variance of coordinate 0 per label (long form)."""
    from ..operators import distance as D

    e = _emb(spark, sf)
    return D.coefficient_stats(e, ["label"], col="x", j=0).select("label", "statistic", F.round("value", 8).alias("value"))


def sql_coef_stats_emb():
    return ("WITH t AS (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS mean, var_pop(CAST(embedding[1] AS DOUBLE)) AS variance "
            "FROM embeddings GROUP BY label)\n"
            "SELECT label, statistic, round(value, 8) AS value FROM (UNPIVOT t ON mean, variance INTO NAME statistic VALUE value)")


# ---------------------------------------------------------------- summaries (G) with oracles

def q_summary_lineitem(spark, sf):
    """G1 (+G4 band): per line number median, sd, MAD, q75, q25 of discount, median tax."""
    from ..operators import summary as G

    li = T.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("size"),
                                               F.col("l_discount").alias("ratio"), F.col("l_tax").alias("total_time_s"))
    s = G.sweep_summary(li, ["size"], "ratio", "total_time_s")
    return s.select("size", *[F.round(c, 8).alias(c) for c in ["median_ratio", "std", "mad", "q75", "q25",
                                                                 "median_total_time_s"]],
                    F.round(G.robust_band(F.col("q75"), F.col("median_ratio")), 8).alias("band_hi"))


def sql_summary_lineitem():
    return ("WITH m AS (SELECT l_linenumber AS size, quantile_cont(l_discount, 0.5) AS med FROM lineitem GROUP BY 1),\n"
            "mad AS (SELECT l_linenumber AS size, quantile_cont(abs(l_discount - med), 0.5) AS mad FROM lineitem "
            "JOIN m ON l_linenumber = m.size GROUP BY 1),\n"
            "s AS (SELECT l_linenumber AS size, quantile_cont(l_discount, 0.5) AS median_ratio, stddev_samp(l_discount) AS std, "
            "quantile_cont(l_discount, 0.75) AS q75, quantile_cont(l_discount, 0.25) AS q25, "
            "quantile_cont(l_tax, 0.5) AS median_total_time_s FROM lineitem GROUP BY 1)\n"
            "SELECT s.size, round(median_ratio, 8) AS median_ratio, round(std, 8) AS std, round(mad, 8) AS mad, "
            "round(q75, 8) AS q75, round(q25, 8) AS q25, round(median_total_time_s, 8) AS median_total_time_s, "
            "round((q75 - median_ratio) * 0.7413 + median_ratio, 8) AS band_hi FROM s JOIN mad ON s.size = mad.size")


def q_result_sizes(spark, sf):
    """Result tables with different columns put together by name; their distinct sizes with row counts."""
    from ..operators import summary as G

    li = T.table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("size"), F.col("l_discount").alias("ratio"))
    od = T.table(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).cast("long").alias("size"), F.lit("orders").alias("method"))
    both = G.union_all([li, od])
    sizes = G.distinct_values(both, "size")
    return sizes.join(both.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count("ratio").alias("n_ratio"), F.count("method").alias("n_method")), "size")


def sql_result_sizes():
    return ("WITH b AS (SELECT CAST(l_linenumber AS BIGINT) AS size, l_discount AS ratio, NULL AS method FROM lineitem UNION ALL\n"
            "SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT), NULL, 'orders' FROM orders)\n"
            "SELECT size, count(*) AS n, count(ratio) AS n_ratio, count(method) AS n_method FROM b GROUP BY size")


def q_five_number_orders(spark, sf):
    """Box summary (min, q25, median, q75, max) of total price per order status."""
    from ..operators import summary as G

    o = T.table(spark, sf, "orders")
    t = G.five_number(o, ["o_orderstatus"], "o_totalprice")
    return t.select("o_orderstatus", *[F.round(c, 6).alias(c) for c in ["min", "q25", "median", "q75", "max"]])


def sql_five_number_orders():
    return ("SELECT o_orderstatus, round(min(o_totalprice), 6) AS min, round(quantile_cont(o_totalprice, 0.25), 6) AS q25, "
            "round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q75, "
            "round(max(o_totalprice), 6) AS max FROM orders GROUP BY 1")


def q_melt_design_l4(spark, sf):
    """Select, unpivot the wide design, coefficient index from the name, method tag."""
    from ..operators import preprocess as PP

    des = T.lineitem_design(spark, sf)
    wide = des.wide(O.R6).select("id", *[f"x_{j}" for j in range(des.d)])
    long = PP.melt(wide, ["id"], [f"x_{j}" for j in range(des.d)])
    long = PP.tag(long.withColumn("j", PP.coefficient_index(F.col("variable"))), method="design")
    return long.filter(F.col("j").isin([0, 1, 2]))


def sql_melt_design_l4():
    xs = ", ".join(f"round(x{j}, 6) AS x_{j}" for j in range(5))
    return (f"WITH {O.l4_cte()},\nw AS (SELECT id, {xs} FROM l4),\n"
            "u AS (UNPIVOT w ON x_0, x_1, x_2, x_3, x_4 INTO NAME variable VALUE value)\n"
            "SELECT id, variable, value, CAST(split_part(variable, '_', 2) AS INTEGER) AS j, 'design' AS method "
            "FROM u WHERE CAST(split_part(variable, '_', 2) AS INTEGER) IN (0, 1, 2)")


# ---------------------------------------------------------------- sweeps (H)

def _sweep(spark, sf, method, p=2.0, design="l4", **kw):
    from .sweep import sweep

    des = T.lineitem_design(spark, sf) if design == "l4" else T.orders_design(spark, sf)
    return sweep(des, method, p=p, sizes=[200, 400], runs=[1, 2, 3], seed=0, **kw)


def q_sweep_uniform_l4(spark, sf):
    """H1-H3: uniform sweep (sizes 200, 400 x runs 1-3), p = 2."""
    return _sweep(spark, sf, "uniform").select("run", "size", F.round("ratio", 6).alias("ratio"))


def sql_sweep_uniform_l4():
    scored = f"WITH {O.l4_cte()},\nscored AS (SELECT *, 1.0 AS score FROM l4)"
    return O.sweep_sql(scored, "l4", 5, 2.0, "sweep:uniform", [200, 400], [1, 2, 3], weighted=False)


def q_sweep_grid_l4(spark, sf):
    """H1 + H3: a uniform sweep over a config grid table (sizes 150 and 300, two runs), p = 1."""
    from .sweep import config_grid, sweep

    des = T.lineitem_design(spark, sf)
    return sweep(des, "uniform", p=1.0, seed=0, grid=config_grid(spark, 150, 300, 150, 2)).select(
        "run", "size", F.round("ratio", 6).alias("ratio"))


def sql_sweep_grid_l4():
    scored = f"WITH {O.l4_cte()},\nscored AS (SELECT *, 1.0 AS score FROM l4)"
    return O.sweep_sql(scored, "l4", 5, 1.0, "sweep:uniform", [150, 300], [1, 2], weighted=False, steps=10)


def abs_price_score(design):
    """A sampler hook: rows far from the mean price are drawn more often."""
    return design.df.withColumn("score", F.abs(F.col("x")[0]) + F.lit(1.0))


def q_sweep_hook_o1(spark, sf):
    """G12 + H2: a sweep with a user's score function on orders, p = 2."""
    return _sweep(spark, sf, abs_price_score, design="o1").select("run", "size", F.round("ratio", 6).alias("ratio"))


def sql_sweep_hook_o1():
    scored = f"WITH {O.o1_cte()},\nscored AS (SELECT *, abs(x0) + 1.0 AS score FROM o1)"
    return O.sweep_sql(scored, "o1", 2, 2.0, "sweep:abs_price_score", [200, 400], [1, 2, 3], weighted=True)


def q_sweep_leverage_l4(spark, sf):
    """H6: leverage sweep (fast sketch scores, augmented, rounded), p = 2."""
    return _sweep(spark, sf, "leverage").select("run", "size", F.round("ratio", 6).alias("ratio"))


def sql_sweep_leverage_l4():
    body = _sql_sketch_scores(False, raw=True)
    scored = f"{body},\nscored AS (SELECT * REPLACE ({O.round_up_sql('(score + 1.0 / n)')} AS score) FROM raw)"
    return O.sweep_sql(scored, "l4", 5, 2.0, "sweep:leverage", [200, 400], [1, 2, 3], weighted=True)


def q_sweep_leverage_online_l4(spark, sf):
    """H6 + C22 (online scores computed once and reused for every config), p = 2."""
    return _sweep(spark, sf, "leverage", online=True).select("run", "size", F.round("ratio", 6).alias("ratio"))


def sql_sweep_leverage_online_l4():
    return O.sweep_sql(_sql_scored(True), "l4", 5, 2.0, "sweep:leverage", [200, 400], [1, 2, 3], weighted=True)


def q_sweep_lewis_o1(spark, sf):
    """H4: Lewis sweep (fast), p = 1, on orders."""
    return _sweep(spark, sf, "lewis", p=1.0, design="o1").select("run", "size", F.round("ratio", 6).alias("ratio"))


def sql_sweep_lewis_o1():
    body = _sql_lewis_sketched(True)
    body = body[:body.rindex("\nSELECT")]
    scored = f"{body},\nscored AS (SELECT o1.*, w20.w + 1.0 / o1.n AS score FROM o1 JOIN w20 USING (id))"
    return O.sweep_sql(scored, "o1", 2, 1.0, "sweep:lewis", [200, 400], [1, 2, 3], weighted=True, steps=10)


def q_sweep_logit_l4(spark, sf):
    """H7: root-leverage sweep, p = 1."""
    return _sweep(spark, sf, "logit", p=1.0).select("run", "size", F.round("ratio", 6).alias("ratio"))


def sql_sweep_logit_l4():
    scored = f"{_sql_sketch_scores(True, raw=True)},\nscored AS (SELECT * FROM raw)"
    return O.sweep_sql(scored, "l4", 5, 1.0, "sweep:logit", [200, 400], [1, 2, 3], weighted=True, steps=10)


def q_sweep_sgd_l4(spark, sf):
    """H5: SGD 'sweep' (one epoch per run, no reduction)."""
    from .sweep import sgd_sweep

    des = T.lineitem_design(spark, sf)
    return sgd_sweep(des, 2.0, runs=[1, 2], seed=0).select("run", "size", "ratio")


def q_sweep_summary_l4(spark, sf):
    """H11 + G1/G6/G11: three-method sweep, per (method, size) summary sorted by time."""
    from ..operators import summary as G
    from .sweep import run_methods

    des = T.lineitem_design(spark, sf)
    res = run_methods(des, 2.0, sizes=[200, 400], runs=[1, 2, 3]).persist()
    summ = G.sweep_summary(res, ["method", "size"], "ratio", "total_time_s")
    inv = G.run_inventory(res.withColumn("p", F.lit(2.0)).withColumn("dataset", F.lit("lineitem")))
    out = G.sort_by(summ.join(inv.select("method", "max_run"), "method"), "median_total_time_s")
    return out.select("method", "size", "max_run", *[F.round(c, 6).alias(c) for c in ("median_ratio", "q25", "q75", "mad", "std")])


def sql_sweep_summary_l4():
    each = {"uniform": sql_sweep_uniform_l4(), "leverage": sql_sweep_leverage_l4(), "leverage_online": sql_sweep_leverage_online_l4()}
    runs = " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM ({q.replace('round(lb.f / lf.f, 6) AS ratio', 'lb.f / lf.f AS ratio')})" for m, q in each.items())
    return (f"WITH res AS MATERIALIZED ({runs}),\n"
            "med AS (SELECT method, size, median(ratio) AS med FROM res GROUP BY method, size)\n"
            "SELECT method, size, max(run) AS max_run, round(any_value(med), 6) AS median_ratio, round(quantile_cont(ratio, 0.25), 6) AS q25,\n"
            "  round(quantile_cont(ratio, 0.75), 6) AS q75, round(median(abs(ratio - med)), 6) AS mad, round(stddev_samp(ratio), 6) AS std\n"
            "FROM res JOIN med USING (method, size) GROUP BY method, size")


def q_size_search_l4(spark, sf):
    """H12 + E14 + G8: bisection for a coreset size with eps in [0.05, 0.1] per run, p = 2,
    with the l2 / l_inf distance of the coreset beta to the full-data beta."""
    from ..operators import summary as G
    from .sweep import size_search

    des = T.lineitem_design(spark, sf)
    res = size_search(des, 2.0, runs=[1, 2], lo=10, hi=2000)
    return res.join(G.smallest_size_in_band(res, group="p", size="k", eps="eps"), "p", "left")


# ---------------------------------------------------------------- files

def q_files_orders(spark, sf):
    """Orders (run = priority digit) materialised as parquet, written as
    per-run CSV folders, appended again with the run offset, read back as CSV with the run
    parsed from each file path; per-run row counts and price sums."""
    from ..session import scratch_path
    from ..sources import files as FS

    base = scratch_path(spark, "files")
    od = T.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("run"),
        "o_totalprice")
    od = FS.materialize(od, base + "/orders")
    FS.write_runs(od, base + "/runs", fmt="csv")
    FS.append_with_run_offset(od, base + "/runs", fmt="csv")
    back = FS.read_run_files(spark, base + "/runs/run=*/*.csv", schema="id BIGINT, o_totalprice DOUBLE")
    run = "run" if "file_run" not in back.columns else "file_run"
    return back.groupBy(F.col(run).alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def sql_files_orders():
    return ("WITH o AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS run, o_totalprice FROM orders),\n"
            "a AS (SELECT run, o_totalprice FROM o UNION ALL\n"
            "      SELECT run + (SELECT max(run) FROM o), o_totalprice FROM o)\n"
            "SELECT run, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM a GROUP BY run")


def q_libsvm_orders(spark, sf):
    """A5: the orders design written as svmlight text (zeros left out) and read back; rows and sums per label."""
    from ..session import scratch_path
    from ..sources import files as FS

    des = T.orders_design(spark, sf)
    path = scratch_path(spark, "svm")
    FS.write_libsvm(des.df.select("y", "x"), path)
    back = FS.read_libsvm(spark, path, num_features=des.d)
    return back.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"),
                                 F.round(F.sum(F.col("x")[0]), 6).alias("s0"), F.round(F.sum(F.col("x")[1]), 6).alias("s1"))


def sql_libsvm_orders():
    return (f"WITH {O.o1_cte()}\nSELECT y, count(*) AS n, count(*) AS ids, round(sum(x0), 6) AS s0, round(sum(x1), 6) AS s1 FROM o1 GROUP BY y")


def q_libsvm_sparse_l4(spark, sf):
    """A5 kept sparse: line items as svmlight text and back; cells and Gram from the non-zeros."""
    from ..operators import sparse as SP
    from ..session import scratch_path
    from ..sources import files as FS

    des = T.lineitem_design(spark, sf)
    path = scratch_path(spark, "svm")
    FS.write_libsvm(des.df.select("y", "x"), path)
    back = FS.read_libsvm_sparse(spark, path)
    cells = back.select("y", F.explode(F.arrays_zip("idx", "val")).alias("c"))
    sums = cells.groupBy("y", F.col("c.idx").alias("j")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c.val"), 6).alias("s"))
    G = SP.gram(back, des.d)
    diag = spark.createDataFrame([(j, round(float(G[j, j]) / des.n, 6), round(float(G[j, 0]) / des.n, 6)) for j in range(des.d)], "j INT, g DOUBLE, g0 DOUBLE")
    return sums.join(diag, "j")


def sql_libsvm_sparse_l4():
    cells = " UNION ALL ".join(f"SELECT y, {j} AS j, x{j} AS v FROM l4 WHERE x{j} <> 0" for j in range(5))
    g = " UNION ALL ".join(f"SELECT {j} AS j, round(sum(x{j} * x{j}) / count(*), 6) AS g, round(sum(x{j} * x0) / count(*), 6) AS g0 FROM l4" for j in range(5))
    return (f"WITH {O.l4_cte()},\nc AS ({cells}), g AS ({g})\n"
            "SELECT c.j, y, count(*) AS n, round(sum(v), 6) AS s, any_value(g) AS g, any_value(g0) AS g0 FROM c JOIN g ON c.j = g.j GROUP BY c.j, y")


def q_sparse_leverage_l4(spark, sf):
    """C7 on non-zeros: leverage scores of sparse line items."""
    from ..operators import sparse as SP

    des = T.lineitem_design(spark, sf)
    return SP.leverage_scores(SP.sparse_rows(des.df), des.d).select("id", F.round("score", 8).alias("score"))


def sql_sparse_leverage_l4():
    return f"WITH {O.l4_cte()},\n{O.leverage_cte('lev', 'l4', 5)}\nSELECT id, round(score, 8) AS score FROM lev"


def q_sparse_countsketch_l4(spark, sf):
    """C2 on non-zeros, the same cells as the dense sketch."""
    from ..operators import sparse as SP

    des = T.lineitem_design(spark, sf)
    s = S.sketch_size(des.n, des.d, 2.0)
    return SP.countsketch(SP.sparse_rows(des.df), s, seed=0).select("bucket", "j", F.round("value", 6).alias("value"))


def sql_sparse_countsketch_l4():
    return sql_countsketch_l4()


def q_fit_lbfgs_l4(spark, sf):
    """E8/E9 by limited-memory quasi-Newton steps on sparse rows: the optimum of fit_l4."""
    from ..operators import sparse as SP

    des = T.lineitem_design(spark, sf)
    r = SP.fit(SP.sparse_rows(des.df), 2.0, des.d)
    return spark.createDataFrame([(j, float(b)) for j, b in enumerate(r.beta)], "j INT, beta DOUBLE").withColumn("beta", F.round("beta", 4))


def sql_fit_lbfgs_l4():
    return sql_fit_l4()


def q_beta_store_o1(spark, sf):
    """Full-data beta_opt of the orders design (p = 2) stored as (dataset, p, j, beta) rows
    in a parquet folder and read back for that dataset and p."""
    from ..session import scratch_path
    from ..sources import files as FS

    des = T.orders_design(spark, sf)
    path = scratch_path(spark, "beta")
    FS.save_beta(spark, path, "orders", 2.0, P.fit(des.df, 2.0, des.d, check=False).beta)
    b = FS.load_beta(spark, path, "orders", 2.0)
    return spark.createDataFrame([("orders", 2.0, j, float(round(v, 6))) for j, v in enumerate(b)],
                                 "dataset STRING, p DOUBLE, j INT, beta DOUBLE")


# ---------------------------------------------------------------- registry

def queries():
    return {k[2:]: v for k, v in globals().items() if k.startswith("q_") and callable(v)}


def oracle_sql():
    out = {}
    for k, v in globals().items():
        if k.startswith("sql_") and callable(v):
            out[k[4:]] = v()
    return out
