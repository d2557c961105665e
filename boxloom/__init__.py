"""Exact spatial-join analytics over boxes on Spark, with operators for training-data pipelines."""
