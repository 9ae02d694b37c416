"""Operators that run over streams."""
