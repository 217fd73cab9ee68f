"""Conversation analytics on Spark DataFrames, and operators for preparing training text."""
