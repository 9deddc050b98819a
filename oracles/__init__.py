"""Independent SQL statements of the named queries, for DuckDB over the same Parquet tables."""
