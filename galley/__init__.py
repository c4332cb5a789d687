"""galley: a Spark-first engine for news intelligence over large item collections."""

__version__ = "0.1.0"
