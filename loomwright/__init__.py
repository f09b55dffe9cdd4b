"""Basket mining, graph analytics, key profiling and log-driven tuning on Spark DataFrames."""

__version__ = "0.1.0"
