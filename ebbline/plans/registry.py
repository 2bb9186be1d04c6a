"""All queries of the reference's own operators."""

from . import alert_queries, kpi_queries, quality_queries, ranking_queries, rollup_queries, source_queries, stats_queries, variance_queries  # noqa: F401
from .catalog import QUERIES as QUERIES
from .catalog import SQL as SQL
