"""Size analytics over content-addressed object graphs, as Spark DataFrames."""

__version__ = "0.1.0"
