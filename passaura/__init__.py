"""Record verification and text-corpus operators for Spark DataFrames."""
