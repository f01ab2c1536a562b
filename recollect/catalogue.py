"""The registered queries and, beside each, the SQL that must agree with it."""

from __future__ import annotations

from recollect.queries import QUERIES, SQL, aggregates, filters, gates, graphs, lexicon, search, writes

__all__ = ["QUERIES", "SQL", "aggregates", "filters", "gates", "graphs", "lexicon", "search", "writes"]
