"""Registry of every implemented query: Spark callables and DuckDB oracle SQL."""

from __future__ import annotations

import importlib

_MODULES = ("vote_queries", "model_queries", "draws_queries", "fit_queries", "dims_queries", "source_queries")


def _load():
    queries, sql = {}, {}
    for m in _MODULES:
        try:
            mod = importlib.import_module(f"{__name__}.{m}")
        except ModuleNotFoundError as e:
            if e.name and e.name.endswith(m):
                continue
            raise
        queries.update(mod.Q)
        sql.update(mod.SQL)
    return queries, sql


def queries():
    return _load()[0]


def _positive_zero(sql: str) -> str:
    """Wrap every ``round(...)`` as ``CAST(0.0 AS DOUBLE) + round(...)``: DuckDB
    keeps the sign of a tiny negative value rounded to zero (-0.0), Spark does not."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j])
        out.append("(CAST(0.0 AS DOUBLE) + round(" + _positive_zero(sql[j + 6:k]) + "))")
        i = k + 1


def oracle_sql():
    return {k: _positive_zero(v) for k, v in _load()[1].items()}
