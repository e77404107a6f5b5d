"""Incremental (Structured Streaming) form of the cohort analysis."""

from churnlens.streaming.cohorts import (  # noqa: F401
    activity_from_pairs, person_month_pairs, run_pairs_available_now,
)
