"""Vector-set compression, reconstruction and retrieval as PySpark jobs."""

from vecsnap.session import local_session

__all__ = ["local_session"]
