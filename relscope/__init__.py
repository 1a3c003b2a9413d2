"""relscope: relational business logic as ordinary Python functions, planned as Spark DataFrames."""

__version__ = "0.1.0"
