"""Meterlake: usage analytics for AI-tool request telemetry, expressed as Spark jobs."""
