"""Operators over hot and cold DataFrames."""
