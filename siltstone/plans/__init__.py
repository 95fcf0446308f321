"""The query catalogue over the driver's tables, each query with its DuckDB statement."""
