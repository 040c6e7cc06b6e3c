"""Interval, fragment and sequence analytics for epigenomic data on Spark DataFrames."""
