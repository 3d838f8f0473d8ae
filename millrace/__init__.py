"""millrace: a Spark-first analytics engine (batch, windows, documents, vectors, streams)."""

from .session import load, session

__all__ = ["load", "session"]
