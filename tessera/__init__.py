"""Analytics over software-structure facts, as Spark DataFrames."""
