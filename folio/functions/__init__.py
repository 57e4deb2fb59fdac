"""Scalar functions: Column in, Column out, all in the JVM."""
