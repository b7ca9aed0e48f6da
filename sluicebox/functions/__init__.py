"""Column -> Column expressions; all JVM-side, no Python functions on rows."""
