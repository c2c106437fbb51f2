"""mirrorframe: synthetic tabular data, quality metrics and privacy policies on Spark DataFrames."""

__version__ = "0.1.0"
