"""Segmentation analytics on Spark DataFrames."""
