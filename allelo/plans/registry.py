"""All core queries with their DuckDB SQL, by name."""

from __future__ import annotations

from . import histories, posteriors, preparation, trees

MODULES = (preparation, histories, posteriors, trees)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in sorted(m.QUERIES.items())}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
