"""Content-addressed dedup and delta-sync analytics on DataFrames."""
