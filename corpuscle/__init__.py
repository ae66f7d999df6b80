"""Dictionary entity matching and table-scale data checks as Spark plans."""

__version__ = "0.1.0"
