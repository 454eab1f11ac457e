"""Cohort-scale analytics for 3-D vessel scans, as Spark DataFrame jobs."""

__version__ = "0.1.0"
