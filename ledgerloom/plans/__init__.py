"""Reports.  Each function takes DataFrames and returns one flat DataFrame, lazily."""
