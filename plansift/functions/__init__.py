"""Column expressions: DataFrame-free building blocks, all evaluated in the JVM."""
