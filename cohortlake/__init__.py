"""Interval analytics and cohort genotyping on Spark DataFrames."""
