"""All queries of the library proper, and their SQL."""

from . import join_queries, linkage_queries, process_queries, review_queries, search_queries, text_queries

_MODULES = [text_queries, join_queries, linkage_queries, search_queries, review_queries, process_queries]
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
