"""meterline: Spark-native jobs for AI coding-tool usage telemetry.

Token counters, list-price cost estimates, commit and session activity,
expressed as DataFrame / Structured Streaming jobs. See README.md.
"""

__all__ = ["session"]
