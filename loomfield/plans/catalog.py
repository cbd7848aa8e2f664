"""All registered queries of the spatial operators and the SQL they are held against."""

from __future__ import annotations

from . import evaluation, evaluation_sql, mapping, mapping_sql, oracles, registry

QUERIES = registry.QUERIES | mapping.QUERIES | evaluation.QUERIES
ORACLES = oracles.ORACLES | mapping_sql.ORACLES | evaluation_sql.ORACLES
