"""The registered queries by group. Each module has QUERIES (name: function of a session and a folder) and SQL (name: DuckDB text)."""
