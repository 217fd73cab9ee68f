"""Interval, frame, listing, search and write operators on plain DataFrames."""
