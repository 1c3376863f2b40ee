"""Trace analytics for asynchronous services, expressed as Spark DataFrame operators."""

__version__ = "0.1.0"
