"""Query registry, DuckDB oracle statements and plan inspection helpers."""
