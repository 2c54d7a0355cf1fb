"""labelforge: build, shape and evaluate labelled text datasets with Spark DataFrames."""

__version__ = "0.1.0"
