"""Registered queries over the driver tables, and the SQL they must equal."""

from __future__ import annotations

from . import attribution, distance, information, linkage, models, sdc, streams, utility

_MODULES = (attribution, sdc, utility, information, distance, linkage, models, streams)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL: dict[str, str] = {name: q for m in _MODULES for name, q in m.SQL.items()}
