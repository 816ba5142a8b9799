"""Scalar rules as SQL text that Spark's codegen evaluates; every function returns an expression, never a UDF."""
