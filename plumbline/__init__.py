"""plumbline: point-in-time relational, temporal and graph analytics on PySpark."""

__version__ = "0.1.0"
