"""Operators over DataFrames: coverage, merge, resolution, audit, classification, time and integrity."""
