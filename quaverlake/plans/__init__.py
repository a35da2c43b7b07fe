"""Input views that queries start from, for Spark and as SQL for DuckDB."""
