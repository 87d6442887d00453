"""lumigrid: frame-by-pixel timeline analytics on PySpark."""

__version__ = "0.1.0"
