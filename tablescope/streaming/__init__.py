"""Streaming: micro-batch quality checks over Structured Streaming sources."""

from tablescope.streaming.dq_monitor import batch_checks, start_quality_monitor

__all__ = ["batch_checks", "start_quality_monitor"]
