"""A Spark library for dynamically typed business records."""
