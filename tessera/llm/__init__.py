"""Operators of a training-data pipeline: filtering, deduplication, classification, tokenising and packing of texts.

Nothing else in the library imports this subpackage; ``queries.py`` binds the operators to the tables of the driver.
"""
