"""Named queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from millrace.plans import join_queries, rule_queries, sequence_queries, source_queries, stats_queries  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES  # noqa: F401
