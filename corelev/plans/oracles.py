"""SQL text for the DuckDB correctness oracle.

These builders only write SQL for the test oracle (tables are the driver's
pre-registered views). Small matrix inverses are unrolled Gauss-Jordan steps
over one-row CTEs; kernels reuse the library's own SQL rendering in the
``duckdb`` dialect.
"""

from __future__ import annotations

from ..functions import pnormal as PN
from ..functions.random import uniform_sql

R6 = 6


def design_cte(name: str, table: str, id_sql: str, label_sql: str, feats, intercept=True,
               order_sql: str | None = None, where: str | None = None) -> str:
    """CTE ``name`` with id, [ord], y, x0..x{d-1}, n. feats = [(sql, standardize)]."""
    raw = [f"{id_sql} AS id", f"CASE WHEN {label_sql} THEN 1 ELSE -1 END AS y"]
    if order_sql:
        raw.append(f"{order_sql} AS ord")
    raw += [f"CAST({f} AS DOUBLE) AS f{i}" for i, (f, _) in enumerate(feats)]
    stats = ["count(*) AS n"]
    for i, (_, std) in enumerate(feats):
        if std:
            stats += [f"avg(f{i}) AS m{i}", f"stddev_pop(f{i}) AS s{i}"]
    xs = []
    for i, (_, std) in enumerate(feats):
        if std:
            xs.append(f"(f{i} - m{i}) / (CASE WHEN s{i} > 0 THEN s{i} ELSE 1 END) AS x{i}")
        else:
            xs.append(f"f{i} AS x{i}")
    if intercept:
        xs.append(f"CAST(1.0 AS DOUBLE) AS x{len(feats)}")
    keep = "id, y" + (", ord" if order_sql else "")
    w = f" WHERE {where}" if where else ""
    return (f"{name}_raw AS (SELECT {', '.join(raw)} FROM {table}{w}),\n"
            f"{name}_st AS (SELECT {', '.join(stats)} FROM {name}_raw),\n"
            f"{name} AS (SELECT {keep}, {', '.join(xs)}, n FROM {name}_raw, {name}_st)")


L4_ID = "concat_ws(':', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), " \
        "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(epoch_us(l_shipdate) AS VARCHAR), " \
        "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))"


def l4_cte(name="l4", ordered=False) -> str:
    feats = [("l_quantity", True), ("l_extendedprice", True), ("l_discount", True), ("l_tax", True)]
    return design_cte(name, "lineitem", L4_ID, "l_returnflag = 'R'", feats, order_sql="l_orderkey * 8 + l_linenumber" if ordered else None)


def o1_cte(name="o1") -> str:
    return design_cte(name, "orders", "o_orderkey", "o_orderstatus = 'F'", [("o_totalprice", True)])


def ev_cte(name="ev") -> str:
    return design_cte(name, "events", "event_id", "event_type = 'error'", [("value", True)],
                      order_sql="event_id")


def gram_cte(name: str, src: str, d: int, weight: str | None = None, ridge: float = 0.0) -> str:
    w = f"{weight} * " if weight else ""
    cols = []
    for i in range(d):
        for j in range(d):
            a, b = min(i, j), max(i, j)
            extra = f" + {ridge!r}" if (ridge and i == j) else ""
            cols.append(f"sum({w}x{a} * x{b}){extra} AS g{i}_{j}")
    return f"{name} AS (SELECT {', '.join(cols)} FROM {src})"


def inverse_ctes(prefix: str, gram: str, d: int) -> tuple[str, str]:
    """Unrolled Gauss-Jordan; returns (ctes, final cte name) with columns v{i}_{j}."""
    ctes = []
    first = []
    for i in range(d):
        for c in range(2 * d):
            src = f"g{i}_{c}" if c < d else ("1.0" if c - d == i else "0.0")
            first.append(f"CAST({src} AS DOUBLE) AS a{i}_{c}")
    ctes.append(f"{prefix}0 AS (SELECT {', '.join(first)} FROM {gram})")
    for k in range(d):
        cols = []
        for i in range(d):
            for c in range(2 * d):
                if i == k:
                    e = f"a{k}_{c} / a{k}_{k}"
                else:
                    e = f"a{i}_{c} - a{i}_{k} * a{k}_{c} / a{k}_{k}"
                cols.append(f"{e} AS a{i}_{c}")
        ctes.append(f"{prefix}{k + 1} AS (SELECT {', '.join(cols)} FROM {prefix}{k})")
    final = f"{prefix}_inv"
    vs = [f"a{i}_{d + j} AS v{i}_{j}" for i in range(d) for j in range(d)]
    ctes.append(f"{final} AS (SELECT {', '.join(vs)} FROM {prefix}{d})")
    return ",\n".join(ctes), final


def quad_sql(d: int, inv: str = "", xs=None) -> str:
    xs = xs or [f"x{i}" for i in range(d)]
    p = f"{inv}." if inv else ""
    return " + ".join(f"{xs[i]} * {xs[j]} * {p}v{i}_{j}" for i in range(d) for j in range(d))


def leverage_cte(name: str, design: str, d: int, ridge: float = 0.0) -> str:
    """CTE ``name`` (id, score) with score = x^T (X^T X + ridge I)^-1 x."""
    g = gram_cte(f"{name}_g", design, d, ridge=ridge)
    inv, fin = inverse_ctes(f"{name}_gj", f"{name}_g", d)
    return f"{g},\n{inv},\n{name} AS (SELECT {design}.*, {quad_sql(d, fin)} AS score FROM {design}, {fin})"


def round_up_sql(s: str) -> str:
    r0 = f"power(2.0, ceil(log2({s})))"
    return (f"(CASE WHEN {s} > 0 THEN (CASE WHEN {r0} < {s} THEN {r0} * 2.0 "
            f"WHEN {r0} / 2.0 >= {s} THEN {r0} / 2.0 ELSE {r0} END) ELSE {s} END)")


def u(id_sql="id", seed=0, stream="u", stream_sql=None) -> str:
    return uniform_sql(id_sql, seed, stream, "duckdb", stream_sql)


def loss_select(p: float, beta, d: int, src: str, tail: str = "exact") -> str:
    """CTE body with z, s, lc, g, gp for fixed beta over design ``src``."""
    dot = " + ".join(f"x{j} * {float(b)!r}" for j, b in enumerate(beta))
    s = PN.sql_s("z", p, "duckdb")
    lc = PN.sql_ln_cdf_neg("z", "s", p, "duckdb")
    g, gp = PN.sql_from_lcdf("z", "s", "lc", p, "duckdb", tail=tail)
    return (f"lz AS (SELECT {src}.*, -y * ({dot}) AS z FROM {src}),\n"
            f"ls AS (SELECT *, {s} AS s FROM lz),\n"
            f"lc AS (SELECT *, {lc} AS lc FROM ls),\n"
            f"lg AS (SELECT *, {g} AS g, {gp} AS gp FROM lc)")


def cholesky_inverse_ctes(prefix: str, gram: str, d: int) -> tuple[str, str]:
    """CTEs giving li{i}_{j} = (L^-1)_{ij} for G = L L^T (lower L), from g{i}_{j} columns."""
    ctes = []
    prev = gram
    for j in range(d):
        cols = []
        acc = " + ".join(f"l{j}_{k} * l{j}_{k}" for k in range(j)) or "0"
        cols.append(f"sqrt(g{j}_{j} - ({acc})) AS l{j}_{j}")
        ctes.append(f"{prefix}d{j} AS (SELECT *, {cols[0]} FROM {prev})")
        prev = f"{prefix}d{j}"
        offs = []
        for i in range(j + 1, d):
            acc = " + ".join(f"l{i}_{k} * l{j}_{k}" for k in range(j)) or "0"
            offs.append(f"(g{i}_{j} - ({acc})) / l{j}_{j} AS l{i}_{j}")
        if offs:
            ctes.append(f"{prefix}o{j} AS (SELECT *, {', '.join(offs)} FROM {prev})")
            prev = f"{prefix}o{j}"
    for i in range(d):
        cols = [f"1.0 / l{i}_{i} AS li{i}_{i}"]
        for j in range(i):
            acc = " + ".join(f"l{i}_{k} * li{k}_{j}" for k in range(j, i))
            cols.append(f"-({acc}) / l{i}_{i} AS li{i}_{j}")
        ctes.append(f"{prefix}i{i} AS (SELECT *, {', '.join(cols)} FROM {prev})")
        prev = f"{prefix}i{i}"
    return ",\n".join(ctes), prev


def q_of_x_sql(d: int, inv: str) -> list:
    """q_k = (L^-1 x)_k as SQL terms over x0..x{d-1}."""
    return ["(" + " + ".join(f"{inv}.li{k}_{j} * x{j}" for j in range(k + 1)) + ")" for k in range(d)]


def _loss_stages(prefix: str, src: str, p: float | None, d: int, group) -> str:
    """CTE ``{prefix}g``: the rows of ``src`` (with b0..b{d-1}) with g, gp, h at margin z = -y x.b (p None: logistic)."""
    dot = " + ".join(f"x{j} * b{j}" for j in range(d))
    z = f"{prefix}z AS (SELECT *, -y * ({dot}) AS z FROM {src})"
    if p is None:
        sig = "(1.0 / (1.0 + exp(-z)))"
        return f"{z},\n{prefix}g AS MATERIALIZED (SELECT *, ln(1.0 + exp(z)) AS g, {sig} AS gp, {sig} * (1.0 - {sig}) AS h FROM {prefix}z)"
    lc = PN.sql_ln_cdf_neg("z", "s", p, "duckdb")
    g, gp = PN.sql_from_lcdf("z", "s", "lc", p, "duckdb")
    return (f"{z},\n{prefix}s AS (SELECT *, {PN.sql_s('z', p, 'duckdb')} AS s FROM {prefix}z),\n"
            f"{prefix}l AS MATERIALIZED (SELECT *, {lc} AS lc FROM {prefix}s),\n"
            f"{prefix}p AS (SELECT *, {g} AS g, {gp} AS gp FROM {prefix}l),\n"
            f"{prefix}g AS MATERIALIZED (SELECT *, {PN.sql_hess('z', 'gp', p, 'duckdb')} AS h FROM {prefix}p)")


def newton_ctes(name: str, src: str, d: int, p: float | None, steps: int, weight: str = "1.0", group=()) -> str:
    """CTE ``name`` (group columns, b0..b{d-1}): ``steps`` Newton steps from 0 on sum weight * g(-y x.b), per group."""
    keys = list(group)
    ks = "".join(f"{k}, " for k in keys)
    by = f" GROUP BY {', '.join(keys)}" if keys else ""
    bs = ", ".join(f"b{j}" for j in range(d))
    out = [f"{name}0 AS MATERIALIZED (SELECT DISTINCT {ks}{', '.join(f'CAST(0.0 AS DOUBLE) AS b{j}' for j in range(d))} FROM {src})"]
    for t in range(steps):
        n = f"{name}{t}"
        join = f"JOIN {n} USING ({', '.join(keys)})" if keys else f"CROSS JOIN {n}"
        out.append(f"{n}r AS (SELECT * FROM {src} {join})")
        out.append(_loss_stages(n, f"{n}r", p, d, keys))
        sums = [f"sum({weight} * h * x{i} * x{j}) AS a{i}_{j}" for i in range(d) for j in range(d)]
        sums += [f"sum(-({weight}) * gp * y * x{i}) AS a{i}_{d}" for i in range(d)]
        sums += [f"any_value(b{j}) AS b{j}" for j in range(d)]
        out.append(f"{n}e0 AS MATERIALIZED (SELECT {ks}{', '.join(sums)} FROM {n}g{by})")
        for k in range(d):
            cells = [(f"a{k}_{c} / a{k}_{k}" if i == k else f"a{i}_{c} - a{i}_{k} * a{k}_{c} / a{k}_{k}") + f" AS a{i}_{c}"
                     for i in range(d) for c in range(k, d + 1)]
            rest = [f"a{i}_{c}" for i in range(d) for c in range(k)]
            out.append(f"{n}e{k + 1} AS MATERIALIZED (SELECT {ks}{', '.join(cells + rest)}, {bs} FROM {n}e{k})")
        moved = ", ".join(f"b{j} - a{j}_{d} AS b{j}" for j in range(d))
        out.append(f"{name}{t + 1} AS MATERIALIZED (SELECT {ks}{moved} FROM {n}e{d})")
    out.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}{steps})")
    return ",\n".join(out)


def loss_of_ctes(name: str, design: str, betas: str, d: int, p: float, group=()) -> str:
    """CTE ``name`` (group columns, f): sum g(-y x.b) over the whole design for every row of ``betas``."""
    keys = list(group)
    ks = "".join(f"{k}, " for k in keys)
    by = f" GROUP BY {', '.join(keys)}" if keys else ""
    return (f"{name}r AS (SELECT * FROM {design} CROSS JOIN {betas}),\n{_loss_stages(name, f'{name}r', p, d, keys)},\n"
            f"{name} AS MATERIALIZED (SELECT {ks}sum(g) AS f FROM {name}g{by})")


def sweep_sql(scored: str, design: str, d: int, p: float, tag: str, sizes, runs, weighted: bool, steps: int = 9) -> str:
    """Ratios (run, size, ratio) of race samples by ``score`` of ``scored`` (a WITH body that ends in CTE ``scored``)."""
    u_run = u("id", stream_sql=f"'{tag}:' || CAST(run AS VARCHAR)")
    xs = ", ".join(f"x{j}" for j in range(d))
    w = "1.0 / (p * size)" if weighted else "1.0"
    runs_ = ", ".join(f"({r})" for r in runs)
    sizes_ = ", ".join(f"({s})" for s in sizes)
    return (f"{scored},\nruns AS (SELECT CAST(r AS INTEGER) AS run FROM (VALUES {runs_}) v(r)),\n"
            f"sizes AS (SELECT CAST(s AS INTEGER) AS size FROM (VALUES {sizes_}) v(s)),\n"
            "tot AS (SELECT sum(score) AS t FROM scored),\n"
            f"ranked AS MATERIALIZED (SELECT run, y, {xs}, score / t AS p, row_number() OVER (PARTITION BY run ORDER BY -ln({u_run}) / score, id) AS rk "
            f"FROM scored, runs, tot WHERE score > 0 QUALIFY rk <= {max(sizes)}),\n"
            f"core AS MATERIALIZED (SELECT run, size, y, {xs}, {w} AS wt FROM ranked, sizes WHERE rk <= size),\n"
            + newton_ctes("nb", "core", d, p, steps, "wt", ["run", "size"]) + ",\n"
            + newton_ctes("nf", design, d, p, steps) + ",\n"
            + loss_of_ctes("lb", design, "nb", d, p, ["run", "size"]) + ",\n" + loss_of_ctes("lf", design, "nf", d, p) + "\n"
            "SELECT run, size, round(lb.f / lf.f, 6) AS ratio FROM lb, lf")
