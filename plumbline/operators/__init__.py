"""Operators over DataFrames: splits, evaluation, ranks, decisions, calibration, fits, checks and comparisons."""
