"""Import every module that registers queries."""

from aerolith.plans import flagship, series_queries, summary_queries, table_queries, stats_queries, ml_queries, stream_queries, wide_queries  # noqa: F401
