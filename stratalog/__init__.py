"""stratalog: an evidence-first analytics engine for layered, append-only data on PySpark."""

__version__ = "0.1.0"
