"""Python data sources and sinks for the binary index and archive formats."""
