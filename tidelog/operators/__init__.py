"""Operators over changelogs and runs; each takes and gives DataFrames."""
