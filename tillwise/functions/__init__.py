"""Column expressions. Everything here is built from JVM-side Spark functions."""
