"""Registered queries: one Spark DataFrame builder and (where expressible) one DuckDB oracle SQL per operator.

Every builder takes ``(spark, sf_dir)``, reads the driver tables through :mod:`cyclelake.sources.fixtures`
and returns a lazy DataFrame over the whole tables. Every computed double is rounded to 6 places on both
sides and every column is aliased to the same name on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import CTE_SQL

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query builder; ``sql`` is the body that follows the shared fixture CTEs."""

    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = portable_rounding(CTE_SQL + sql)
        return fn

    return deco


def portable_rounding(sql: str) -> str:
    """Rewrite every ``round(expr, 6)`` into the engine-independent form used by ``functions.columns.r6``."""
    out, i, token = [], 0, "round("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        k, depth, last_comma = j + len(token), 1, -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                last_comma = k
            k += 1
        inner, digits = sql[j + len(token):last_comma], sql[last_comma + 1:k - 1].strip()
        out.append(sql[i:j])
        if digits == "6":
            x = portable_rounding(inner)
            out.append(f"(CASE WHEN abs({x}) < 1e9 THEN floor(({x}) * 1000000.0 + 0.5) / 1000000.0 ELSE {x} END)")
        else:
            out.append(sql[j:k])
        i = k


def load_all() -> None:
    """Import every module that registers queries."""
    from . import queries_features, queries_cells, queries_quality, queries_summary, queries_pipeline, queries_runs, queries_surface  # noqa: F401
