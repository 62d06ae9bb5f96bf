"""Operators of a training-data pipeline: scoring, deduplication, decontamination, packing, archives.

Nothing else in the library imports this subpackage. Every operator takes DataFrames and returns one;
``queries`` registers the query of each operator.
"""
