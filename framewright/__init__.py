"""Image data-set preparation, scoring and evaluation on Spark DataFrames."""
