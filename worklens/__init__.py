"""Work-ledger analytics as functions from DataFrames to DataFrames."""
