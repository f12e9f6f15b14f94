"""All registered queries and the DuckDB SQL that each must agree with."""

from __future__ import annotations

from . import documents, relations, streams

QUERIES = documents.QUERIES | relations.QUERIES | streams.QUERIES
ORACLES = documents.ORACLES | relations.ORACLES | streams.ORACLES
FLAGSHIP = "payload_flat"
