"""Spark-first analytics over tables of source code: rules, features, tokens, graphs, slices, scoring."""

__version__ = "0.1.0"
