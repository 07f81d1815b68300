"""Scalar semantics that Spark's own functions don't have, as column expressions and SQL macros."""
