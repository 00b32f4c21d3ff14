"""Column expressions: everything here is a plain JVM-side expression, no Python UDFs."""
