"""lexiarc: analytics over multilingual document collections, as Spark DataFrames."""

__version__ = "0.1.0"
