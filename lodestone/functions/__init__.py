"""Column expressions: vectors, text, array metrics. All of them run inside the JVM."""
