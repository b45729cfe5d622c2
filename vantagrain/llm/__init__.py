"""Operators for preparing large language-model training corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin queries of the driver surface are in ``llm.queries``.
"""
