"""All queries of the traffic engine with their DuckDB counterparts."""

from netloom.plans import analysis, experiments, streams, traffic

PARTS = (traffic, analysis, experiments, streams)
QUERIES = {k: f for p in PARTS for k, f in p.QUERIES.items()}
ORACLE_SQL = {k: s for p in PARTS for k, s in p.ORACLE.items()}
