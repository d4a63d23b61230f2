"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from meterflow.queries import admission, labels, series, services

MODULES = (labels, series, admission, services)
QUERIES = {k: f for m in MODULES for k, f in m.Q.queries.items()}
SQL = {k: s for m in MODULES for k, s in m.Q.sql.items()}
