"""Column expressions: no Python runs per row anywhere in this folder."""
