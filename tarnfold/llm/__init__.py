"""Operators for building training data from web-scale text.

Nothing outside this subpackage imports it; ``queries`` registers the query of
each operator and ``corpus_pipeline.py`` chains five of them.
"""
