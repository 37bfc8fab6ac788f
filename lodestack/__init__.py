"""Evidence analytics on PySpark: versioned repository and document evidence as DataFrames."""
