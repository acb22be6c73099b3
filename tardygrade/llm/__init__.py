"""Operators for preparing training text; ``llm.catalog`` registers one query for each."""
