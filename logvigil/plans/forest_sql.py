"""DuckDB formulation of the isolation forest (oracle for M2-M5, M8).

Generated SQL: the same hash draws, per-tree ranking, level-by-level
splits and fixed-point path lengths as :mod:`logvigil.operators.iforest`,
written as chained CTEs (one group-by and one join per tree level), then
every row walks every tree with one join per level.
"""

from __future__ import annotations

import math

from logvigil.operators.iforest import EULER_GAMMA, FIXED_POINT


def _u(tag_sql: str) -> str:
    return f"(CAST(('0x' || substr(md5({tag_sql}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def _word(tag_sql: str, i: int) -> str:
    return f"CAST(('0x' || substr(md5({tag_sql}), {1 + 8 * i}, 8)) AS BIGINT)"


def _c(n_sql: str) -> str:
    return (f"(CASE WHEN {n_sql} <= 1 THEN 0.0::DOUBLE WHEN {n_sql} = 2 THEN 1.0::DOUBLE "
            f"ELSE 2.0::DOUBLE * (ln(CAST({n_sql} - 1 AS DOUBLE)) + {EULER_GAMMA!r}::DOUBLE) "
            f"- 2.0::DOUBLE * CAST({n_sql} - 1 AS DOUBLE) / {n_sql} END)")


def forest_ctes(source: str, features: list[str], trees: int, psi_max_depth: tuple[int, int],
                seed: int, row_id: str = "seq") -> list[str]:
    """CTEs ending in ``fscore(row_id, score)``.  ``psi_max_depth`` is
    (psi, max depth for min(psi, n)); the caller knows n's range."""
    psi, depth = psi_max_depth
    nf = len(features)
    xs = ", ".join(f"CAST({f} AS DOUBLE) AS x{i}" for i, f in enumerate(features))
    xcols = ", ".join(f"x{i}" for i in range(nf))
    tag = repr(f"{seed}:") + " || CAST(row_id AS VARCHAR)"
    ctes = [
        f"fx0 AS (SELECT {row_id} AS row_id, {xs} FROM {source})",
        f"fx AS (SELECT *, {_word(tag, 1)} AS ka, {_word(tag, 2)} AS kb FROM fx0)",
        f"fn AS (SELECT LEAST({psi}, COUNT(*)) AS psi_eff FROM fx)",
        f"fsamp AS (SELECT CAST(t.tree AS BIGINT) AS tree, p.* FROM fx p CROSS JOIN "
        f"range({trees}) t(tree) QUALIFY row_number() OVER (PARTITION BY t.tree ORDER BY "
        f"(p.ka + t.tree * p.kb) % 4294967296, row_id) <= (SELECT psi_eff FROM fn))",
        f"a0 AS (SELECT tree, row_id, {xcols}, CAST(1 AS BIGINT) AS node FROM fsamp)",
    ]
    pick_x = lambda alias: "CASE c.feat " + " ".join(
        f"WHEN {i} THEN {alias}.x{i}" for i in range(nf)) + " END"
    inner = []
    for lvl in range(depth):
        mins = ", ".join(f"min(x{i}) AS mn{i}, max(x{i}) AS mx{i}" for i in range(nf))
        ctes.append(f"st{lvl} AS (SELECT tree, node, COUNT(*) AS sz, {mins} FROM a{lvl} "
                    f"WHERE node >= {2 ** lvl} GROUP BY tree, node)")
        cand = ", ".join(f"CAST(mx{i} > mn{i} AS INTEGER) AS c{i}" for i in range(nf))
        ctes.append(
            f"cd{lvl} AS (SELECT *, {cand}, "
            f"{_u(repr('f:' + str(seed) + ':') + ' || CAST(tree AS VARCHAR) || ' + repr(':') + ' || CAST(node AS VARCHAR)')} AS uf, "
            f"{_u(repr('s:' + str(seed) + ':') + ' || CAST(tree AS VARCHAR) || ' + repr(':') + ' || CAST(node AS VARCHAR)')} AS us "
            f"FROM st{lvl})")
        cums = ", ".join(f"{' + '.join(f'c{j}' for j in range(i + 1))} AS k{i}" for i in range(nf))
        ctes.append(f"cc{lvl} AS (SELECT *, {cums} FROM cd{lvl})")
        ctes.append(f"cp{lvl} AS (SELECT *, CAST(floor(uf * k{nf - 1}) AS BIGINT) + 1 AS pick "
                    f"FROM cc{lvl} WHERE sz > 1 AND k{nf - 1} > 0)")
        feat = "CASE " + " ".join(f"WHEN c{i} = 1 AND k{i} = pick THEN {i}" for i in range(nf)) + " END"
        ctes.append(f"cf{lvl} AS (SELECT tree, node, {feat} AS feat, * EXCLUDE (tree, node) "
                    f"FROM cp{lvl})")
        thr = "CASE feat " + " ".join(
            f"WHEN {i} THEN mn{i} + us * (mx{i} - mn{i})" for i in range(nf)) + " END"
        ctes.append(f"ch{lvl} AS (SELECT tree, node, feat, {thr} AS thr FROM cf{lvl})")
        inner.append(f"SELECT tree, node, feat, thr FROM ch{lvl}")
        ctes.append(
            f"a{lvl + 1} AS (SELECT a.tree, a.row_id, {', '.join(f'a.x{i}' for i in range(nf))}, "
            f"CASE WHEN c.feat IS NULL THEN a.node ELSE 2 * a.node + "
            f"CAST(({pick_x('a')}) > c.thr AS BIGINT) END AS node "
            f"FROM a{lvl} a LEFT JOIN ch{lvl} c ON a.tree = c.tree AND a.node = c.node)")
    ctes.append(f"leafsz AS (SELECT tree, node, COUNT(*) AS sz FROM a{depth} GROUP BY tree, node)")
    ctes.append("fin AS (" + (" UNION ALL ".join(inner) if inner else
                              "SELECT 0 AS tree, 0 AS node, 0 AS feat, 0.0 AS thr WHERE false") + ")")
    ctes.append(f"s0 AS (SELECT fx.row_id, {xcols}, CAST(t.tree AS BIGINT) AS tree, CAST(1 AS BIGINT) AS node, "
                f"CAST(0 AS BIGINT) AS depth FROM fx CROSS JOIN range({trees}) t(tree))")
    for lvl in range(depth):
        ctes.append(
            f"s{lvl + 1} AS (SELECT s.row_id, {', '.join(f's.x{i}' for i in range(nf))}, s.tree, "
            f"CASE WHEN c.feat IS NULL THEN s.node ELSE 2 * s.node + "
            f"CAST(({pick_x('s')}) > c.thr AS BIGINT) END AS node, "
            f"s.depth + CASE WHEN c.feat IS NULL THEN 0 ELSE 1 END AS depth "
            f"FROM s{lvl} s LEFT JOIN fin c ON s.tree = c.tree AND s.node = c.node)")
    ctes.append(
        f"funits AS (SELECT s.row_id, CAST(SUM(s.depth * {FIXED_POINT} + CAST(floor("
        f"{_c('COALESCE(l.sz, 0)')} * {float(FIXED_POINT)!r}::DOUBLE) AS BIGINT)) AS BIGINT) AS units "
        f"FROM s{depth} s LEFT JOIN leafsz l ON s.tree = l.tree AND s.node = l.node "
        f"GROUP BY s.row_id)")
    ctes.append(
        f"fscore AS (SELECT u.row_id, -pow(2.0::DOUBLE, -(((CAST(u.units AS DOUBLE) / "
        f"{float(FIXED_POINT)!r}::DOUBLE) / {trees}) / {_c('fn.psi_eff')})) AS score "
        f"FROM funits u, fn)")
    return ctes


def batch_forest_ctes(source: str, features: list[str], trees: int, rows: int, seed: int,
                      contamination: float, batch: str = "batch_id", row_id: str = "seq") -> list[str]:
    """CTEs ending in ``bflag(row_id, batch, score, is_anomaly)``: a forest per
    batch of ``rows`` rows, each tree grown on all of them.  The draws depend
    on tree and node only; a row's path ends at the leaf it was grown into."""
    depth, nf = depth_for(rows), len(features)
    xcols = ", ".join(f"x{i}" for i in range(nf))
    xs = ", ".join(f"CAST({f} AS DOUBLE) AS x{i}" for i, f in enumerate(features))
    ctes = [f"b0 AS (SELECT {row_id} AS row_id, {batch} AS g, CAST(t.tree AS BIGINT) AS tree, {xs}, "
            f"CAST(1 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth FROM {source} "
            f"CROSS JOIN range({trees}) t(tree))"]
    draws = ", ".join(
        f"{_u(repr(f'{k}:{seed}:') + ' || CAST(tree AS VARCHAR) || ' + repr(':') + ' || CAST(node AS VARCHAR)')} AS u{k}"
        for k in "fs")
    for lvl in range(depth):
        agg = ", ".join(f"min(x{i}) AS mn{i}, max(x{i}) AS mx{i}" for i in range(nf))
        cum = ", ".join(" + ".join(f"CAST(mx{j} > mn{j} AS INTEGER)" for j in range(i + 1)) + f" AS k{i}"
                        for i in range(nf))
        pick = "CAST(floor(uf * k%d) AS BIGINT) + 1" % (nf - 1)
        feat = "CASE " + " ".join(f"WHEN mx{i} > mn{i} AND k{i} = {pick} THEN {i}"
                                  for i in range(nf)) + " END"
        thr = "CASE feat " + " ".join(f"WHEN {i} THEN mn{i} + us * (mx{i} - mn{i})"
                                      for i in range(nf)) + " END"
        mine = "CASE c.feat " + " ".join(f"WHEN {i} THEN a.x{i}" for i in range(nf)) + " END"
        ctes += [
            f"bs{lvl} AS (SELECT g, tree, node, COUNT(*) AS sz, {agg} FROM b{lvl} "
            f"WHERE node >= {2 ** lvl} GROUP BY g, tree, node)",
            f"bk{lvl} AS (SELECT *, {cum}, {draws} FROM bs{lvl})",
            f"bf{lvl} AS (SELECT *, {feat} AS feat FROM bk{lvl} WHERE sz > 1 AND k{nf - 1} > 0)",
            f"bt{lvl} AS (SELECT g, tree, node, feat, {thr} AS thr FROM bf{lvl})",
            f"b{lvl + 1} AS (SELECT a.row_id, a.g, a.tree, {', '.join(f'a.x{i}' for i in range(nf))}, "
            f"CASE WHEN c.feat IS NULL THEN a.node ELSE 2 * a.node + CAST(({mine}) > c.thr AS BIGINT) "
            f"END AS node, a.depth + CASE WHEN c.feat IS NULL THEN 0 ELSE 1 END AS depth "
            f"FROM b{lvl} a LEFT JOIN bt{lvl} c ON a.g = c.g AND a.tree = c.tree AND a.node = c.node)"]
    ctes += [
        f"bl AS (SELECT g, tree, node, COUNT(*) AS sz FROM b{depth} GROUP BY g, tree, node)",
        f"bu AS (SELECT a.row_id, a.g, CAST(SUM(a.depth * {FIXED_POINT} + CAST(floor({_c('l.sz')} * "
        f"{float(FIXED_POINT)!r}::DOUBLE) AS BIGINT)) AS BIGINT) AS units FROM b{depth} a JOIN bl l "
        f"ON a.g = l.g AND a.tree = l.tree AND a.node = l.node GROUP BY a.row_id, a.g)",
        f"bscore AS (SELECT row_id, g, -pow(2.0::DOUBLE, -(((CAST(units AS DOUBLE) / "
        f"{float(FIXED_POINT)!r}::DOUBLE) / {trees}) / {_c(str(rows))})) AS score FROM bu)",
        f"brank AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score) - 1 AS rk, "
        f"{contamination!r}::DOUBLE * (COUNT(*) OVER (PARTITION BY g) - 1) AS pos FROM bscore)",
        "bthr AS (SELECT a.g, CASE WHEN a.pos - a.rk > 0 THEN a.score + (b.score - a.score) * "
        "(a.pos - a.rk) ELSE a.score END AS thr FROM brank a JOIN brank b ON a.g = b.g AND b.rk = "
        "LEAST(a.rk + 1, " + str(rows - 1) + ") WHERE a.rk = CAST(floor(a.pos) AS BIGINT))",
        "bflag AS (SELECT s.row_id, s.g AS batch, s.score, s.score < t.thr AS is_anomaly "
        "FROM bscore s JOIN bthr t USING (g))"]
    return ctes


def quantile_cte(name: str, source: str, column: str, q: float) -> str:
    """Linear-interpolation quantile ``a + (b - a) * frac`` as one-row CTE ``name``."""
    return (f"{name}_r AS (SELECT {column} AS v, row_number() OVER (ORDER BY {column}) - 1 AS rk, "
            f"COUNT(*) OVER () AS n FROM {source} WHERE {column} IS NOT NULL),\n"
            f"{name}_p AS (SELECT DISTINCT n, {q!r}::DOUBLE * (n - 1) AS pos, "
            f"CAST(floor({q!r}::DOUBLE * (n - 1)) AS BIGINT) AS k FROM {name}_r),\n"
            f"{name} AS (SELECT CASE WHEN p.pos - p.k > 0 THEN a.v + (b.v - a.v) * (p.pos - p.k) "
            f"ELSE a.v END AS threshold FROM {name}_p p JOIN {name}_r a ON a.rk = p.k "
            f"JOIN {name}_r b ON b.rk = LEAST(p.k + 1, p.n - 1))")


def depth_for(psi: int) -> int:
    return int(math.ceil(math.log2(max(psi, 2))))
