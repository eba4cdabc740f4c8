"""Cohort construction and causal time-to-event analytics on Spark DataFrames."""
