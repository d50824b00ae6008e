"""All registered queries outside the optional subpackage."""

from __future__ import annotations

from crosspan.plans import data_queries, factor_queries, hourly_queries, portfolio_queries, research_queries, stream_queries

MODULES = (factor_queries, hourly_queries, research_queries, portfolio_queries, data_queries, stream_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
