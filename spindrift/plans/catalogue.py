"""Every query of the engine by name, with the SQL that it is held against."""

from __future__ import annotations

from spindrift.plans import code, content, graphs, relational, reports, services, sources, texts
from spindrift.plans.registry import Query

_PARTS = (relational.R, graphs.R, content.R, reports.R, services.R, code.R, sources.R, texts.R)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for part in _PARTS:
        out |= part.queries
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in _PARTS:
        out |= part.sql
    return out
