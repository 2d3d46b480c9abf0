"""Column -> Column scalar helpers (all JVM-side built-in expressions)."""
