"""Cross-sectional panel research on Spark DataFrames."""
