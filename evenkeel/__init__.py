"""evenkeel: data parity, change replay and database telemetry on Spark.

Every operator is a plain function from DataFrames to a DataFrame.
"""
