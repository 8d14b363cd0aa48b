"""Entity resolution, enrichment and search over people and publications, on Spark."""

from rosterlink.session import configure, staged

__all__ = ["configure", "staged"]
