"""Plumbline: profiling, cleaning, analytics and forecasting of tables, as Spark DataFrames."""
