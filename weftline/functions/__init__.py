"""Scalar expressions, all on the JVM side."""
