"""Opinion analytics over social streams, as functions from DataFrames to DataFrames."""
