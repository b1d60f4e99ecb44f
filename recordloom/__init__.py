"""Record consolidation and change detection on Spark DataFrames."""
