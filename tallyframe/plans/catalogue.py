"""All queries of the core, and SQL with the same results."""

from __future__ import annotations

from tallyframe.plans import batch_queries, data_queries, reference_queries

FLAGSHIP = "recon_compare"
QUERIES = {**data_queries.QUERIES, **reference_queries.QUERIES, **batch_queries.QUERIES}
SQL = {**data_queries.SQL, **reference_queries.SQL, **batch_queries.SQL}
