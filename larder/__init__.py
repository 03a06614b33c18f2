"""larder: versioned key-value data as DataFrames, on PySpark."""
