"""Column functions: every one stays inside the JVM."""
