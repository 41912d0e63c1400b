"""Column expressions and small linear algebra."""
