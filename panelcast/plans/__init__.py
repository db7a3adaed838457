"""End-to-end jobs composed from the operators (training tables, VAR report)."""
