"""Karstflow: graph community analytics and corpus preparation on Spark DataFrames."""
