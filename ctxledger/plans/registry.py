"""All registered queries of the library's own operators."""

from __future__ import annotations

from ctxledger.plans import activity, collapse, compaction, cost, dialog, planning, requests

_MODULES = (cost, dialog, activity, compaction, requests, planning, collapse)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
