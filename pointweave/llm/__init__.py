"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage.  Every operator takes
and returns DataFrames; the thin ``opN_*`` queries over the standard tables
are in :mod:`pointweave.llm.queries`.
"""
