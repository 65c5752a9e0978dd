"""Analytics over very large sparse operator sums, and the data operations around them, on PySpark DataFrames."""
