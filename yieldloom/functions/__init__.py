"""Column expressions; all JVM-side, none looks at more than its own row."""
