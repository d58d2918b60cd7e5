"""Table sources (fixture views over driver tables, CSV/parquet readers) and sinks."""
