"""strata: keyed changelogs as layered, sorted, versioned Parquet runs, on Spark DataFrames."""

__version__ = "0.1.0"
