"""Scalar column functions; every one stays inside the JVM."""
