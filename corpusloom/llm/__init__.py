"""Operators of a training-data pipeline: deduplication, filtering, packing and encoding of text corpora.

Nothing outside this subpackage imports it. Every operator takes a DataFrame and column names, keeps its own general
interface, and works alike at every size; ``queries`` derives the registered result tables from the operators.
"""
