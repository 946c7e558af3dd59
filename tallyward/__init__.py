"""Transaction-risk analytics as Spark DataFrame functions."""
