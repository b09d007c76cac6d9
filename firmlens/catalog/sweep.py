"""SQL text that solves normal equations by sweeping: the check on the least-squares engine."""

from __future__ import annotations

INDUSTRIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def design_list(terms: list[str], years: list[int], industries: bool = True, y: str = "y", weight: str | None = None) -> str:
    """The row vector [1, terms, industry dummies, year dummies, y] as a list expression."""
    cols = ["1.0"] + ["coalesce(" + " * ".join(f"CAST({p} AS DOUBLE)" for p in t.split(":")) + ", 0)" for t in terms]
    if industries:
        cols += [f"CASE WHEN industry = '{i}' THEN 1.0 ELSE 0 END" for i in INDUSTRIES[1:]]
    cols += [f"CASE WHEN year = {v} THEN 1.0 ELSE 0 END" for v in years[1:]]
    return "CAST([" + ", ".join(cols + [y]) + "] AS DOUBLE[])"


def width(terms, years, industries=True) -> int:
    return 1 + len(terms) + (len(INDUSTRIES) - 1 if industries else 0) + len(years) - 1


def gram(src: str, keys: list[str], q: int, w: str = "1.0") -> str:
    k = ", ".join(keys)
    return (f"SELECT {k}, i, j, sum({w} * v[i] * v[j]) AS g FROM {src}, (SELECT unnest(range(1, {q + 1})) AS i), (SELECT unnest(range(1, {q + 1})) AS j) GROUP BY {k}, i, j")


def sweep(src: str, keys: list[str], p: int, prefix: str) -> tuple[str, str]:
    """CTE text sweeping columns 1..p of ``src`` (keys, i, j, g); returns (text, name of the last CTE)."""
    on = lambda x: " AND ".join(f"a.{k} = {x}.{k}" for k in keys)
    ks = ", ".join(f"a.{k}" for k in keys)
    parts = [f"{prefix}0 AS MATERIALIZED (SELECT {', '.join(keys)}, i, j, g, g AS o FROM {src})"]
    for k in range(1, p + 1):
        prev = f"{prefix}{k - 1}"
        parts.append(f"""{prefix}{k} AS MATERIALIZED (SELECT {ks}, a.i, a.j, a.o, CASE WHEN d.g <= 1e-9 * d.o THEN CASE WHEN a.i = {k} OR a.j = {k} THEN 0 ELSE a.g END
 WHEN a.i = {k} AND a.j = {k} THEN -1 / d.g WHEN a.i = {k} OR a.j = {k} THEN a.g / d.g ELSE a.g - b.g * c.g / d.g END AS g
 FROM {prev} a JOIN {prev} b ON {on('b')} AND b.i = a.i AND b.j = {k} JOIN {prev} c ON {on('c')} AND c.i = {k} AND c.j = a.j JOIN {prev} d ON {on('d')} AND d.i = {k} AND d.j = {k})""")
    return ",\n".join(parts), f"{prefix}{p}"


def fits(last: str, keys: list[str], p: int) -> str:
    """(keys, beta list, rss, n, rank, yy, sy) from a finished sweep."""
    k = ", ".join(keys)
    q = p + 1
    return (f"SELECT {k}, list(CASE WHEN j = {q} AND i <= {p} THEN g END ORDER BY i) FILTER (WHERE j = {q} AND i <= {p}) AS beta, max(CASE WHEN i = {q} AND j = {q} THEN g END) AS rss, "
            f"max(CASE WHEN i = 1 AND j = 1 THEN o END) AS n, count(CASE WHEN i = j AND i <= {p} AND g <> 0 THEN 1 END) AS rank, max(CASE WHEN i = {q} AND j = {q} THEN o END) AS yy, max(CASE WHEN i = 1 AND j = {q} THEN o END) AS sy FROM {last} GROUP BY {k}")
