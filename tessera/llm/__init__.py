"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Every operator is a plain function
from DataFrames to DataFrames; :mod:`tessera.llm.queries` holds the thin
``opN_*`` queries over the standard tables.
"""
