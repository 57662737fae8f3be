"""Structured Streaming form of the incremental loads (high-water mark,
MERGE by key, late-data reprocessing of the daily fact)."""

from .ingest import stage_stream, start_staging_stream, refresh_daily

__all__ = ["stage_stream", "start_staging_stream", "refresh_daily"]
