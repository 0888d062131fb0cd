"""Small generators for the DuckDB oracle text (independent of the Spark code paths)."""

from __future__ import annotations

from collections.abc import Sequence


def dbl(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def nearest_quantiles_cte(name: str, table: str, cols: Sequence[str], qs: Sequence[float],
                          key: str = "cell_id") -> str:
    """CTE ``name`` with one row per key and ``{col}_pNN`` nearest-rank quantiles: values are numbered per key, and a
    quantile is the value at its place."""
    out, picked = "", [f"k.{key}"]
    joins = ""
    for c in cols:
        one = f"{name}_{c}"
        places = ", ".join(f"max(CASE WHEN rn = round((n - 1) * {dbl(q)}) + 1 THEN x END) AS {c}_p{round(q * 100):02d}" for q in qs)
        out += (f"\n, {one}_n AS (SELECT {key}, {c} AS x, row_number() OVER (PARTITION BY {key} ORDER BY {c}) AS rn, "
                f"count(*) OVER (PARTITION BY {key}) AS n FROM {table} WHERE {c} IS NOT NULL)"
                f"\n, {one} AS (SELECT {key}, {places} FROM {one}_n GROUP BY {key})")
        joins += f" LEFT JOIN {one} ON k.{key} = {one}.{key}"
        picked += [f"{one}.{c}_p{round(q * 100):02d}" for q in qs]
    return f"{out}\n, {name} AS (SELECT {', '.join(picked)} FROM (SELECT DISTINCT {key} FROM {table}) k{joins})"


def r6(expr: str) -> str:
    return f"round({expr}, 6)"
