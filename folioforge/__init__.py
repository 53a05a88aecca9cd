"""Document-curation analytics on Spark: DataFrame in, DataFrame out."""
