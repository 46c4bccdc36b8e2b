"""Column expressions; everything here is evaluated by Spark's own functions."""
