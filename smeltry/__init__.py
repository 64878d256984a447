"""smeltry: Spark-first building blocks for retail lakehouse tables.

Every operator is a function from DataFrames to a DataFrame. Operators never
start actions, create sessions or read the clock: dates and cut-offs are
arguments, so a result can be repeated for any day.
"""

__version__ = "0.1.0"
