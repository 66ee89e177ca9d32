"""Dataset curation and robustness evaluation on Spark DataFrames."""
