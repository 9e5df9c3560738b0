"""Scalar expressions; all of them built-in column operations unless stated."""
