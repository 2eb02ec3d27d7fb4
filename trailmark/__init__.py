"""AI-crawler and content-readiness analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
