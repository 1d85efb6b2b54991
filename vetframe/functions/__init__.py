"""Scalar functions as Column expressions, and the byte parsers behind the image UDFs."""
