"""SQL of least-squares fits: normal equations, eliminated by a recursive query."""

from __future__ import annotations

from collections.abc import Sequence

from tidemark.sources.sites import SITES_SQL

RECURSIVE = "WITH RECURSIVE " + SITES_SQL

#: The terms of `fits.harmonic_terms(3)` with the constant, as SQL over unit vectors x, y, z.
TERMS_SQL = ("1.0::DOUBLE", "x", "y", "z", "x * y", "y * z", "3 * z * z - 1", "x * z", "x * x - y * y", "y * (3 * x * x - y * y)", "x * y * z", "y * (5 * z * z - 1)", "z * (5 * z * z - 3)", "x * (5 * z * z - 1)", "z * (x * x - y * y)", "x * (x * x - 3 * y * y)")


def least_squares_sql(source: str, by: Sequence[str], terms: Sequence[str], sizes: Sequence[int], target: str = "z_m", name: str = "ls", ridge: str = "0") -> str:
    """CTEs that end in `{name}` (by, d, n, sz, szz, beta, inverse, r2): for each group the fit of `target` on the first d of `terms`, by Gauss-Jordan elimination of the normal equations, which must have full rank.

    `ridge` is added to the diagonal, an expression over the group's columns and i, the number of the term. `inverse` is that of the matrix of sums; r2 is right without a ridge.
    """
    keys = ", ".join(by)
    on = " AND ".join(f"a.{b} IS NOT DISTINCT FROM t.{b}" for b in by)
    last = len(terms) + 1
    return f"""{name}_f AS (SELECT {keys}, CAST({target} AS DOUBLE) AS target, [{', '.join(f'CAST({t} AS DOUBLE)' for t in terms)}, CAST({target} AS DOUBLE)] AS f FROM {source}),
    {name}_p AS (SELECT {keys}, i, j, sum(f[i] * f[j]) + CASE WHEN i = j THEN CAST({ridge} AS DOUBLE) ELSE 0 END AS s FROM {name}_f, (SELECT unnest(range(1, {last})) AS i), (SELECT unnest(range(1, {last + 1})) AS j) GROUP BY {keys}, i, j),
    {name}_r AS (SELECT {keys}, d, i, list_concat(list(s ORDER BY j), list_transform(range(1, d + 1), lambda c: CASE WHEN c = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS r FROM {name}_p, (SELECT unnest([{', '.join(map(str, sizes))}]) AS d) WHERE i <= d AND (j <= d OR j = {last}) GROUP BY {keys}, d, i),
    {name}_m AS (SELECT {keys}, d, list(r ORDER BY i) AS m FROM {name}_r GROUP BY {keys}, d),
    {name}_e AS (SELECT {keys}, d, 1 AS pv, m FROM {name}_m UNION ALL SELECT {keys}, d, pv + 1, list_transform(m, lambda r, i: CASE WHEN i = pv THEN list_transform(r, lambda v: v / m[pv][pv]) ELSE list_transform(r, lambda v, j: v - r[pv] * m[pv][j] / m[pv][pv]) END) FROM {name}_e WHERE pv <= d),
    {name}_b AS (SELECT {keys}, d, list_transform(m, lambda r: r[d + 1]) AS beta, list_transform(m, lambda r: r[d + 2 : 2 * d + 1]) AS inverse FROM {name}_e WHERE pv = d + 1),
    {name}_t AS (SELECT {keys}, count(*) AS n, sum(target) AS sz, sum(target * target) AS szz FROM {name}_f GROUP BY {keys}),
    {name} AS (SELECT a.*, t.n, t.sz, t.szz, (list_inner_product(a.beta, (SELECT list(s ORDER BY i) FROM {name}_p p WHERE {' AND '.join(f'p.{b} IS NOT DISTINCT FROM a.{b}' for b in by)} AND i <= a.d AND j = {last})) - sz * sz / n) / nullif(szz - sz * sz / n, 0) AS r2 FROM {name}_b a JOIN {name}_t t ON {on})"""
