"""Log triage on Spark: ingest, normalize, score, correlate and report security events."""

from logsift.session import configure, get_session

__all__ = ["configure", "get_session"]
