"""Analytics of long conversations on PySpark DataFrames."""
