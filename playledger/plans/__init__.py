"""Multi-step jobs: building the tables, shared rollups, per-profile insights."""

from .ingest import ingest
from .insights import ingest_report, insights_summary
from .rollup import play_rollup

__all__ = ["ingest", "ingest_report", "insights_summary", "play_rollup"]
