"""Operators over DataFrames: profiling, detection, reports, tokens, context, gate and conversations."""
