"""docengine: analytics over semi-structured documents, built on PySpark."""

__version__ = "0.1.0"
