"""All registered queries outside the optional subpackage, with their DuckDB SQL."""

from __future__ import annotations

from .queries import base, candidates, inventory, plans, reports, scalars, views  # noqa: F401  importing registers


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
